"""Ranks, samples, splits, label sets and reports on skewed fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from manylabel.functions import labels as lb
from manylabel.operators import algebra, clean, evaluate, ranks, sample


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one class and many equal values."""
    rng = np.random.default_rng(5)
    n = 3000
    group = np.where(np.arange(n) < n // 3, 0, rng.integers(0, 9, n))
    value = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, n))
    return pd.DataFrame({"id": rng.permutation(n), "g": group, "v": value})


def test_rank_and_running_sum(spark, skewed):
    df = spark.createDataFrame(skewed)
    out = ranks.with_rank(df, ["g"], [F.col("v").desc(), F.col("id")], size="n").toPandas()
    want = skewed.sort_values(["v", "id"], ascending=[False, True])
    want["rn"] = want.groupby("g").cumcount() + 1
    merged = out.merge(want, on="id")
    assert (merged["rn_x"] == merged["rn_y"]).all() and len(out) == len(skewed)
    assert (out["n"] == out.groupby("g")["id"].transform("size")).all()

    run = ranks.running_sum(df.withColumn("t", F.col("v")), ["g"],
                            [F.col("v").desc(), F.col("id")], ["t"]).toPandas()
    want["t"] = want.groupby("g")["v"].cumsum()
    merged = run.merge(want, on="id")
    assert (merged["t_x"] == merged["t_y"]).all()


def test_order_statistic(spark, skewed):
    got = ranks.order_statistic(spark.createDataFrame(skewed), "g", "v", 0.5).toPandas()
    for g, t in zip(got["g"], got["threshold"]):
        values = sorted(skewed.loc[skewed.g == g, "v"])
        assert t == values[int(len(values) * 0.5)]


def test_order_statistic_index(spark):
    df = spark.createDataFrame([(0, x) for x in (.5, .1, .3, .2, .4)], "g int, v double")
    assert ranks.order_statistic(df, "g", "v", 0.2).first()["threshold"] == .2
    assert ranks.order_statistic(df, "g", "v", 0.5).first()["threshold"] == .3


@pytest.mark.parametrize("n", [5, 1200])
def test_heads_of_groups(spark, skewed, n):
    order = [F.col("v").desc(), F.col("id")]
    got = ranks.head_per_group(spark.createDataFrame(skewed), n, ["g"], order).toPandas()
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(n)
    assert set(got["id"]) == set(want["id"])


def test_balance(spark):
    sizes = {0: 37, 1: 25, 2: 90}
    rows = [(f"{k}-{i}", k, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, class_id int, inst int")
    assert sample.balanced_size(df).first()["n_each_class"] == 20
    picked = sample.balanced_sample(df, "inst", important=["2-0", "2-89"]).toPandas()
    assert picked["id"].is_unique and len(picked) == 61 and "2-0" in set(picked["id"])
    tiny = df.filter("(class_id = 0 and inst < 9) or class_id = 2")
    assert sample.balanced_size(tiny).first()["n_each_class"] == 0
    assert sample.balanced_sample(tiny, "inst", important=["2-5"]).count() == 1


def test_head_split(spark, skewed):
    df = spark.createDataFrame(skewed).withColumnRenamed("g", "class_id")
    parts = sample.head_split(df, [F.col("v").desc(), F.col("id")], 20).toPandas()
    assert (parts[parts.split == "test"].groupby("class_id").size() == 20).all()
    assert len(parts) == len(skewed)


def test_folds(spark, skewed):
    ten = spark.range(10)
    sizes = sample.folds(ten, 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [4, 3, 3]
    df = spark.createDataFrame(skewed)
    strat = sample.folds(df, 4, by="g").toPandas()
    spread = strat.groupby(["g", "fold"]).size().unstack()
    assert (spread.max(axis=1) - spread.min(axis=1) <= 1).all()
    assert set(sample.hash_folds(df, 3).toPandas()["fold"]) == {0, 1, 2}


def test_spies(spark):
    rows = [(i, k) for k, n in ((0, 100), (1, 6), (2, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, class_id int")
    got = sample.sample_spies(df).groupBy("class_id").count().collect()
    assert {r["class_id"]: r["count"] for r in got} == {0: 15, 2: 1}


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "id string, pos int")
    got = clean.dedup_first(df, "id", [F.col("pos")]).collect()
    assert sorted(r["pos"] for r in got) == [0, 1]


@pytest.mark.parametrize("limit, head", [(1 << 30, 10), (0, 10), (0, 1), (0, 100000)])
def test_join_of_frequent_and_rare_terms(spark, limit, head):
    rng = np.random.default_rng(1)
    terms = np.where(rng.random(4000) < 0.33, 0, rng.zipf(1.5, 4000) % 300)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(4000), "term": terms.astype(str)}))
    table = rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("w", F.col("df") * 2)
    out = algebra.join_terms(rows, table, broadcast_bytes=limit, head_terms=head).toPandas()
    count = pd.Series(terms.astype(str)).value_counts()
    assert len(out) == 4000 and (out["w"] == 2 * out["term"].map(count)).all()


def test_label_sets(spark):
    a = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "id int, class_id int")
    b = spark.createDataFrame([(1, 2), (3, 1)], "id int, class_id int")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")

    def rows(df):
        return {tuple(r) for r in df.select("id", "class_id").collect()}

    assert rows(lb.labels_or(a, b)) == {(1, 0), (1, 2), (2, 1), (3, 1)}
    assert rows(lb.labels_and(a, b)) == {(1, 2)}
    assert rows(lb.fallback_labels(b, a)) == {(1, 2), (3, 1), (2, 1)}
    matrix = lb.to_matrix(a, 3, ids)
    assert {r["id"]: list(r["y"]) for r in matrix.collect()} == {
        1: [1, 0, 1], 2: [0, 1, 0], 3: [0, 0, 0], 4: [0, 0, 0]}
    assert rows(lb.to_positives(matrix)) == rows(a)
    assert {r["id"]: r["any_label"] for r in lb.has_any(a, ids).collect()} == {
        1: True, 2: True, 3: False, 4: False}
    assert lb.density(a, None, 3, ids).first()["density"] == pytest.approx(0.25)


def test_reports(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    orig = spark.createDataFrame([(1, 2), (2, 2), (3, 0)], "id int, class_id int")
    a = spark.createDataFrame([(1, 2), (1, 5), (2, 2), (2, 5)], "id int, class_id int")
    b = spark.createDataFrame([(1, 5), (2, 2)], "id int, class_id int")
    names = [f"c{i}" for i in range(6)]
    merged = evaluate.merged_report(ids, orig, {"spysvm": b, "well": a}, names)
    assert merged.columns == ["Package", "Original_Label", "WELL", "SPYSVM"]
    assert {tuple(r) for r in merged.collect()} == {
        (1, "c2", "c2 c5", "c5"), (2, "c2", "c2 c5", "c2"), (3, "c0", "", "")}
    wrong = evaluate.error_report(ids, orig, {"well": a, "spysvm": b}, names)
    assert {r["Package"] for r in wrong.collect()} == {1, 3}


def test_label_counts(spark):
    rows = [(1, 0), (2, 0), (3, 0), (3, 1), (3, 2)]
    df = spark.createDataFrame(rows, "id int, class_id int")
    got = {(r["labels"], r["n"]) for r in evaluate.label_counts({"m": df}).collect()}
    assert got == {(1, 2), (2, 0), (3, 1)}


def test_confusion_has_every_cell(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "y int, pred int")
    cells = {(r["y"], r["pred"]): r["n"] for r in evaluate.confusion(df, [0, 1, 2]).collect()}
    assert len(cells) == 9 and cells[0, 1] == 2 and cells[2, 2] == 0
    wide = evaluate.confusion_wide(df, [0, 1, 2]).orderBy("y").collect()
    assert list(wide[0])[1:] == [0, 2, 0]

"""Queries on support vector machines, grid search and the full enrichment methods.

One optimiser is held against a chain of gradient steps in SQL that runs to the same minimum; the
others, of the same solver, are checked by optimality and property tests. The naive Bayes part of
the grid search is plain counting.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from manylabel.operators import enrich_svm, evaluate
from manylabel.operators.bayes import best_class
from manylabel.operators.sample import head_split
from manylabel.plans.inputs import CLEAN, Q, SOURCES, Corpus, table
from manylabel.plans.registry import query
from manylabel.session import stage


@query("svm_binary")
def svm_binary(spark, sf_dir):
    """Margins of one SVM: documents labelled as good against all others."""
    corpus = Corpus(spark, sf_dir)
    margins = enrich_svm.one_vs_rest_margins(
        corpus.features, corpus.quality(), corpus.ids, 1
    )
    return margins.select("id", F.get("m", F.lit(0)).alias("margin"))


#: Weight of the loss, and accelerated gradient steps to the minimum at that weight.
EMBEDDING_COST, GRADIENT_STEPS = 0.05, 600


def steps_sql(width: int, cost: float, steps: int) -> str:
    """One-vs-rest SVMs on ``embeddings`` by accelerated gradient steps, all classes at once."""
    sums = ", ".join(f"sum(pull * x[{i}])" for i in range(1, width + 2))
    lists = "list_transform(list_zip({0}, {1}), lambda e: {2})"
    moved = lists.format("v", "g", f"e[1] - (e[1] - 2 * {cost} * e[2]) / big")
    ahead = lists.format("u", "w", "e[1] + (sqrt(big) - 1) / (sqrt(big) + 1) * (e[1] - e[2])")
    return f"""WITH RECURSIVE rows AS MATERIALIZED (
  SELECT vec_id, label, list_append(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), 1.0::DOUBLE) AS x FROM embeddings),
bound AS MATERIALIZED (SELECT 1 + 2 * {cost} * sum(list_inner_product(x, x)) AS big FROM rows),
step(i, k, w, v) AS (
  SELECT 0, k, list_resize([0.0::DOUBLE], {width + 1}, 0.0::DOUBLE), list_resize([0.0::DOUBLE], {width + 1}, 0.0::DOUBLE)
  FROM (SELECT DISTINCT label AS k FROM rows)
  UNION ALL
  SELECT i + 1, k, u, {ahead} FROM (
    SELECT i, k, w, big, {moved} AS u FROM (
      SELECT i, k, any_value(w) AS w, any_value(v) AS v, any_value(big) AS big, [{sums}] AS g FROM (
        SELECT i, k, w, v, big, x, CASE WHEN label = k THEN 1.0 ELSE -1.0 END AS s,
               s * greatest(0.0, 1 - s * list_inner_product(v, x)) AS pull
        FROM step CROSS JOIN rows CROSS JOIN bound WHERE i < {steps})
      GROUP BY i, k)))
SELECT vec_id AS id, k AS class_id, round(list_inner_product(w, x), 4) + 0.0 AS margin
FROM step CROSS JOIN rows WHERE i = {steps}"""


@query("svm_embeddings", steps_sql(64, EMBEDDING_COST, GRADIENT_STEPS))
def svm_embeddings(spark, sf_dir):
    """Margins of one SVM for each label of the vectors, every component a feature."""
    vectors = table(spark, sf_dir, "embeddings")
    features = stage(vectors.select(
        F.col("vec_id").alias("id"), F.posexplode("embedding").alias("at", "x")
    ).select("id", F.format_string("%03d", F.col("at")).alias("term"), F.col("x").cast("double").alias("x")), "components")
    ids = vectors.select(F.col("vec_id").alias("id"))
    labels = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("class_id"))
    margins = enrich_svm.one_vs_rest_margins(features, labels, ids, 10, c=EMBEDDING_COST, tol=1e-10, digits=9)
    return margins.select("id", F.posexplode("m").alias("class_id", "m")).select(
        "id", "class_id", (F.round("m", 4) + F.lit(0.0)).alias("margin")
    )


@query("svm_multiclass")
def svm_multiclass(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    margins = enrich_svm.one_vs_rest_margins(
        corpus.features, corpus.labels, corpus.ids, Q, c=1.0
    )
    return margins.select("id", best_class("m").alias("pred"))


@query("naive_well")
def naive_well(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return enrich_svm.naive_well(corpus.features, corpus.labels, corpus.ids, Q)


@query("kfold_well")
def kfold_well(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return enrich_svm.kfold_well(corpus.features, corpus.labels, corpus.ids, Q, max_iters=1)


@query("nb_svm")
def nb_svm(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return enrich_svm.nb_svm(corpus.counts, corpus.features, corpus.labels, corpus.ids, Q)


@query("spy_svm")
def spy_svm(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return enrich_svm.spy_svm(corpus.counts, corpus.features, corpus.labels, corpus.ids, Q)


@query("iter_spy_svm")
def iter_spy_svm(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return enrich_svm.iter_spy_svm(
        corpus.counts, corpus.features, corpus.labels, corpus.ids, Q
    )


def grid_sql(alphas: list[float], k: int = 3) -> str:
    """Mean fold accuracy of multiclass naive Bayes on TF-IDF rows of each fold."""
    values = ", ".join(f"{a}::DOUBLE" for a in alphas)
    return f"""WITH {CLEAN},
counts AS MATERIALIZED (
  SELECT id, class_id, term, count(*) AS tf
  FROM (SELECT id, class_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))
          AS term FROM clean) GROUP BY ALL),
folds AS MATERIALIZED (
  SELECT id, class_id, ntile({k}) OVER (PARTITION BY class_id ORDER BY md5('7:' || id), id) - 1
           AS fold FROM clean),
v AS (SELECT unnest(range({k})) AS v),
train AS MATERIALIZED (SELECT v, id, class_id FROM folds JOIN v ON fold <> v),
sizes AS (SELECT v, count(*)::DOUBLE AS n FROM train GROUP BY v),
df AS MATERIALIZED (SELECT v, term, count(*) AS df FROM train JOIN counts USING (id)
                    GROUP BY ALL),
raw AS (SELECT v, id, c.class_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x
        FROM counts c JOIN df USING (term) JOIN sizes USING (v)),
rows AS MATERIALIZED (
  SELECT v, id, class_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY v, id)) AS x FROM raw),
nk AS MATERIALIZED (SELECT v, r.class_id AS k, term, sum(x) AS c
                    FROM rows r JOIN train USING (v, id) GROUP BY ALL),
tk AS (SELECT v, k, sum(c) AS ck FROM nk GROUP BY ALL),
voc AS (SELECT v, count(*) AS voc FROM df GROUP BY v),
pk AS (SELECT v, class_id AS k, ln(count(*)) - ln(any_value(n)) AS p
       FROM train JOIN sizes USING (v) GROUP BY ALL),
a AS (SELECT unnest([{values}]) AS alpha, unnest(range({len(alphas)})) AS i),
w AS (SELECT d.v, d.term, t.k, i, ln(coalesce(c, 0) + alpha) - ln(ck + alpha * voc) AS w
      FROM df d JOIN tk t USING (v) JOIN voc USING (v) CROSS JOIN a
      LEFT JOIN nk ON nk.v = d.v AND nk.term = d.term AND nk.k = t.k),
s AS (SELECT v, id, k, i, sum(x * w) AS s FROM rows r JOIN folds f USING (id)
      JOIN w USING (v, term) WHERE f.fold = v GROUP BY ALL),
jll AS (SELECT f.fold AS v, f.id, f.class_id, pk.k, a.i, round(coalesce(s, 0) + p, 6) AS m
        FROM folds f JOIN pk ON pk.v = f.fold CROSS JOIN a
        LEFT JOIN s ON s.v = f.fold AND s.id = f.id AND s.k = pk.k AND s.i = a.i),
pred AS (SELECT v, id, class_id, i, arg_max(k, (m, -k)) AS pred FROM jll GROUP BY ALL),
acc AS (SELECT v, i, avg(CAST(pred = class_id AS DOUBLE)) AS acc FROM pred GROUP BY ALL)
SELECT alpha, round(avg(acc), 6) AS accuracy FROM acc JOIN a USING (i) GROUP BY alpha"""


@query("grid_search_nb", grid_sql(enrich_svm.NB_ALPHAS))
def grid_search_nb(spark, sf_dir):
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    result = enrich_svm.grid_search(corpus.counts, corpus.ids, Q, costs=[])
    return spark.createDataFrame(
        [(value, round(mean, 6)) for _, value, mean in result.scores],
        "alpha double, accuracy double",
    )


@query("grid_search")
def grid_search(spark, sf_dir):
    """Search of the whole grid on the training part, report on the hold-out."""
    corpus = Corpus(spark, sf_dir, with_tfidf=False)
    parts = stage(head_split(corpus.ids, [F.col("id")]), "parts")
    train, test = (parts.filter(F.col("split") == s) for s in ("train", "test"))
    result = enrich_svm.grid_search(corpus.counts, train, Q)
    predicted = enrich_svm.refit(corpus.counts, train, test, Q, *result.best)
    joined = test.select("id", F.col("class_id").alias("y")).join(predicted, "id")
    return evaluate.classification_report(joined, range(Q))


@query("enrichment_comparison")
def enrichment_comparison(spark, sf_dir):
    """Merged report of three methods on the same rows."""
    corpus = Corpus(spark, sf_dir)
    n, x, y, ids = corpus.counts, corpus.features, corpus.labels, corpus.ids
    models = {
        "linear_well": stage(enrich_svm.linear_well(x, y, ids, Q, 6), "labels"),
        "naive": stage(enrich_svm.naive_well(x, y, ids, Q), "labels"),
        "nbsvm": stage(enrich_svm.nb_svm(n, x, y, ids, Q), "labels"),
    }
    return evaluate.merged_report(ids, y, models, SOURCES)


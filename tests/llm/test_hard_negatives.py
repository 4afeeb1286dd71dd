"""Hard negatives against brute force, also with lists cut into many short stretches and blocks."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from manylabel.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int, bound double"


def table(n=400, width=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4)) if i % 3 else 1
        v = centres[label] * rng.uniform(0.2, 2) + rng.normal(size=width) * rng.uniform(0.1, 1)
        rows.append((i, [float(np.float32(x)) for x in v], label, "clash", 1, 2.0))
    rows += [(1000 + i, rows[9][1], 2, "copy", 1, 2.0) for i in range(60)]  # one very common vector
    odd = [None, [], [0.0] * width, [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), [1.0, 2.0], [1.5, 1.0], [3e9] * width]
    rows += [(2000 + 50 * i, v, 1, "odd", 1, 2.0) for i, v in enumerate(odd)]
    rows += [(3000, rows[1][1], None, "no label", 1, 2.0), (None, rows[1][1], 1, "no id", 1, 2.0)]
    return rows + rows[40:60]


def brute(rows, positives=5, negatives=3):
    used = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            used[i] = (label, [math.floor(256 * float(np.float64(x))) for x in v])
    out = {}
    for a, (label, u) in used.items():
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(u, w)), i, l == label) for i, (l, w) in used.items() if i != a and len(w) == len(u)]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            good = sorted(x for x in scores if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out.update({(a, p, k + 1): (i, -s, -t) for k, (t, i, _) in enumerate(good)})
    return out


@pytest.mark.parametrize("sizes", [None, (16, 40, 8)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("BLOCK", "STRETCH", "STEP"), sizes):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, per_cluster=4 if sizes else 512).collect()
    got = {(r.anchor_id, r.positive_id, r["rank"]): (r.negative_id, r.positive_score, r.negative_score) for r in out}
    want = brute(rows)
    assert len(got) == len(out) and got == want and len(want) > 50


def test_walks_end_early():
    """A member stops as soon as the bound falls below its worst kept score."""
    import pyarrow as pa

    x = np.array([[float(100 - i), 0.0] for i in range(100)])
    rows = pa.table({"bound": x[:, 0], "vector": pa.array(x.tolist())})
    members = pa.table({"vector": pa.array([[1.0, 0.0]]), "norm": [1.0]})
    seen = []

    def take(alive, scores, at):
        seen.extend(at.tolist())
        return np.array([float(scores.max())])

    step, hard_negatives.STEP = hard_negatives.STEP, 4
    try:
        hard_negatives._in_steps(members, rows, np.array([-np.inf]), take)
    finally:
        hard_negatives.STEP = step
    assert seen == [0, 1, 2, 3]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, centres = rng.normal(size=(300, 5)) * rng.uniform(0.1, 9, (300, 1)), rng.normal(size=(3, 5))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    u = rng.normal(size=(50, 5))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for c in range(3):
        spread = np.arccos(np.clip(u @ centres[c], -1, 1))
        for m in range(50):
            bound = hard_negatives._bounds(x, centres[c : c + 1], spread[m : m + 1])[:, 0]
            assert (x @ u[m] <= bound + 1e-9).all()


def test_no_rows_no_anchors(spark):
    asked = F.col("vec_id") % 50 == 0
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), asked).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(table()[1:9], SCHEMA), asked).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1, "", 1, 1.0)], SCHEMA)
    assert hard_negatives.mine(alone, asked).count() == 0


def test_counts_as_named(spark):
    rows = table()
    out = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 100, n_positives=2, n_negatives=1).collect()
    assert collections.Counter(r.anchor_id for r in out) == {100: len({r.positive_id for r in out})} and len(out) <= 2

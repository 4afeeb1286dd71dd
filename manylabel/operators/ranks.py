"""Exact ranks and running sums without a single-task window.

A window over one class, or over the whole table, sorts that group in one task. Here
rows are range-partitioned on the full sort key (which ends in a unique id, so no value
is too frequent to split), written once, and numbered by partition and position; only
one small row per (group, partition) is needed to turn that into exact global ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from manylabel.session import shuffle_width, stage

# Largest group prefix for which Spark's own per-task window limit keeps windows cheap.
GROUP_LIMIT = 1000


def _in_order(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Stage ``df`` sorted by ``keys`` with ``_part`` and ``_pos`` telling the order."""
    numbered = (
        df.repartitionByRange(shuffle_width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    return stage(numbered, "ordered")


def with_rank(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn",
    size: str | None = None,
) -> DataFrame:
    """``row_number`` within ``by`` in ``order``; ``size`` also adds the group size.

    ``order`` has to end in a unique column for a repeatable result.
    """
    by = list(by)
    rows = _in_order(df, [F.col(c) for c in by] + list(order))
    pieces = rows.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = W.partitionBy(*by).orderBy("_part")
    pieces = pieces.withColumn(
        "_offset", F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    )
    if size:
        pieces = pieces.withColumn(size, F.sum("_n").over(W.partitionBy(*by)))
    ranked = rows.join(pieces, [*by, "_part"]).withColumn(
        name, F.col("_offset") + F.col("_pos") - F.col("_first") + 1
    )
    return ranked.drop("_part", "_pos", "_n", "_first", "_offset")


def head_per_group(
    df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """First ``n`` rows of every group.

    Up to ``GROUP_LIMIT`` rows Spark cuts every group inside the map tasks, so a hot group
    never reaches one task; larger ``n`` goes through the range-partitioned rank.
    """
    if n <= GROUP_LIMIT:
        window = W.partitionBy(*by).orderBy(*order)
        ranked = df.withColumn(name, F.row_number().over(window))
    else:
        ranked = with_rank(df, by, order, name)
    return ranked.filter(F.col(name) <= n)


def hash_order(key: str = "id", seed: int = 7) -> list[Column]:
    """A seeded permutation that does not depend on partitioning."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return [F.md5(text), F.col(key)]


def shuffled(df: DataFrame, key: str = "id", seed: int = 7, name: str = "pos") -> DataFrame:
    """Rows numbered by a seeded random permutation."""
    return with_rank(df, [], hash_order(key, seed), name)


def running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """Inclusive running sums of ``values`` within ``by``, replacing the columns."""
    by, values = list(by), list(values)
    rows = _in_order(df, [F.col(c) for c in by] + list(order))
    inside = W.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    pieces = rows.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    for v in values:
        pieces = pieces.withColumn(
            f"_off_{v}", F.sum(f"_sum_{v}").over(before) - F.col(f"_sum_{v}")
        )
    for v in values:
        rows = rows.withColumn(v, F.sum(v).over(inside))
    rows = rows.join(pieces, [*by, "_part"])
    for v in values:
        rows = rows.withColumn(v, F.col(v) + F.col(f"_off_{v}"))
    return rows.drop("_part", "_pos", *[f"{p}{v}" for p in ("_sum_", "_off_") for v in values])


def order_statistic(df: DataFrame, by: str, value: str, fraction: float) -> DataFrame:
    """Element ``int(n * fraction)`` of the ascending values of every group.

    Values are counted first, so repeated values cost one row each; the running count over
    the distinct values then finds the element.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = df.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    reached = running_sum(counts, [by], [F.col(value)], ["_c"]).join(totals, by)
    wanted = F.floor(F.col("_total") * F.lit(float(fraction))) + 1
    return (
        reached.filter(F.col("_c") >= wanted).groupBy(by).agg(F.min(value).alias("threshold"))
    )

"""Rows that share a key, brought together in units of bounded size, and their components.

A key with more rows than a block is cut into blocks by a hash of the id; every pair of blocks is
a unit of its own, so rows of a hot key spread over tasks and no task gets all of them. A unit
gives links and counts, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.session import LoopState, stage


def in_units(rows: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """Rows with ``lo``, ``hi`` (the unit's blocks) and ``mine``, the row's own block.

    Rows come sorted by unit within partitions, a unit never in two of them. Only keys with more
    rows than a block are looked up; staged, their table has a known size, by which Spark decides
    whether to broadcast it, so rows move once.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("company"))
    hot = stage(counts.filter(F.col("company") > block), "hot-keys")
    blocks = F.coalesce(F.ceil(F.col("company") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), F.col(ident)), blocks).cast("int")
    together = rows.join(hot, keys, "left").withColumn("mine", mine)
    paired = together.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        *rows.columns, "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")
    )
    unit = [*keys, "lo", "hi"]
    return paired.repartition(*unit).sortWithinPartitions(*unit)


def by_unit(
    batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None]
) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with whole units: rows and the offsets of the units in them."""
    carry = None
    for batch in batches:
        if not len(batch):
            continue
        if carry is not None:
            batch = pa.concat_batches([carry, batch])
        starts = _starts(batch, keys)
        carry = batch.slice(starts[-1])
        if len(starts) > 1:
            out = work(batch.slice(0, starts[-1]), starts)
            if out is not None and len(out):
                yield out
    if carry is not None:
        out = work(carry, np.array([0, len(carry)]))
        if out is not None and len(out):
            yield out


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    fresh = np.ones(len(batch), bool)
    fresh[1:] = False
    for k in keys:
        x = batch.column(k).to_numpy(zero_copy_only=False)
        fresh[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each of ``n`` rows over the links ``(a, b)``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """``(id, component)`` of every id in ``edges`` that is not the smallest of its component.

    Large-star and small-star steps in turn: each step hangs the neighbours of a node under the
    smallest of them, until every tree has depth one. The edges of a step are staged, and the
    step before them is removed. Nothing is collected.
    """
    spark = edges.sparkSession
    state = LoopState(spark, label)
    down = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    now = state.put(down)
    while True:
        roots = now.select(F.col("v").alias("u")).distinct()
        once = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = once.join(roots, "u", "left_semi").union(once.filter("n > 1")).limit(1).count()
        if not open_:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        ).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = state.put(small)

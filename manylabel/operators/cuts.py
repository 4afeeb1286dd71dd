"""Threshold sets on a weighted graph given by its edges.

A set is a prefix of the rows by falling ``x``. Its objective is ``alpha`` times the weight of the
edges with one end inside, plus ``1 - beta y`` for each row inside. An edge is cut from the
larger value of its ends on, until the smaller value joins it: it adds its weight at the one
and takes it away at the other. So all prefixes of all classes follow from one pass over the
edges, sums by value and a running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.functions.labels import labels_or
from manylabel.operators.ranks import running_sum
from manylabel.session import stage


def prefix_objectives(nodes: DataFrame, edges: DataFrame, alpha: float, beta: float, digits: int = 6) -> DataFrame:
    """``(class_id, cut, size, value)``: the objective of every candidate set ``x >= cut``.

    ``nodes`` has one row for each ``id`` with arrays ``x`` and ``y``, an element for each class;
    ``edges`` has ``src``, ``dst`` and ``w``. Repeated edges and both directions add up; loops and
    edges to unknown or null ids do nothing; a null element of ``x`` takes no part in its class, a
    null ``y`` is zero. Equal values enter together. The set of all rows is no candidate; the empty one
    (``cut`` null) is one only where several rows share the largest value.
    """
    known = nodes.filter(F.col("id").isNotNull())
    long = known.select(F.posexplode(F.arrays_zip("x", "y")).alias("class_id", "v")).select("class_id", "v.x", "v.y")
    own = long.filter(F.col("x").isNotNull()).groupBy("class_id", "x").agg(
        F.count(F.lit(1)).alias("size"), F.sum(1.0 - beta * F.coalesce("y", F.lit(0.0))).alias("value")
    )
    ends = known.select("id", "x")
    joined = (
        edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
        .join(ends.select(F.col("id").alias("src"), F.col("x").alias("a")), "src")
        .join(ends.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")
    )
    cells = joined.select("w", F.posexplode(F.arrays_zip("a", "b")).alias("class_id", "v")).filter("v.a <> v.b")
    turns = F.array(
        F.struct(F.greatest("v.a", "v.b").alias("x"), (alpha * F.col("w")).alias("value")),
        F.struct(F.least("v.a", "v.b").alias("x"), (-alpha * F.col("w")).alias("value")),
    )
    cut = cells.select("class_id", F.explode(turns).alias("t")).groupBy("class_id", "t.x").agg(F.sum("t.value").alias("value"))
    steps = own.unionByName(cut.withColumn("size", F.lit(0).cast("long"))).groupBy("class_id", "x").agg(
        F.sum("size").alias("size"), F.sum("value").alias("value")
    ).withColumn("n", F.col("size"))
    steps = stage(steps, "steps")
    limits = steps.groupBy("class_id").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    prefix = running_sum(steps, ["class_id"], [F.col("x").desc()], ["size", "value"])
    prefix = stage(prefix.join(F.broadcast(limits), "class_id"), "prefix")
    sets = prefix.filter(F.col("x") > F.col("least")).select(
        "class_id", F.col("x").alias("cut"), "size", (F.round("value", digits) + F.lit(0.0)).alias("value")
    )
    nothing = prefix.filter((F.col("x") == F.col("most")) & (F.col("n") > 1)).select(
        "class_id", F.lit(None).cast(sets.schema["cut"].dataType).alias("cut"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("value")
    )
    return sets.unionByName(nothing)


def best_prefix(nodes: DataFrame, edges: DataFrame, alpha: float, beta: float, digits: int = 6) -> DataFrame:
    """The set of least objective of each class, ``(class_id, cut, size, value)``; ties go to the larger set."""
    sets = prefix_objectives(nodes, edges, alpha, beta, digits)
    order = F.struct(F.col("value"), -F.col("size"))
    best = sets.groupBy("class_id").agg(F.min_by(F.struct("cut", "size", "value"), order).alias("best"))
    return best.select("class_id", "best.*")


def prefix_labels(nodes: DataFrame, edges: DataFrame, labels: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``labels`` and the rows of the best set of each class."""
    best = best_prefix(nodes, edges, alpha, beta).filter(F.col("cut").isNotNull())
    long = nodes.select("id", F.posexplode("x").alias("class_id", "x"))
    inside = long.join(F.broadcast(best), "class_id").filter(F.col("x") >= F.col("cut"))
    return labels_or(labels, inside.select("id", "class_id"))

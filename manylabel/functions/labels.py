"""Set operations and conversions on label tables.

A label set is a long table ``(id, class_id)`` of positives. Its dense form is
``(id, y)`` with ``y`` a 0/1 array in class order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.functions.lists import index_name
from manylabel.functions.vectors import dense_labels


def labels_or(*label_sets: DataFrame) -> DataFrame:
    pairs = [df.select("id", "class_id") for df in label_sets]
    return reduce(DataFrame.unionByName, pairs).distinct()


def labels_and(*label_sets: DataFrame) -> DataFrame:
    """Positives all label sets agree on."""
    tagged = [
        df.select("id", "class_id", F.lit(i).alias("model")) for i, df in enumerate(label_sets)
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("id", "class_id")
        .agg(F.count_distinct("model").alias("models"))
        .filter(F.col("models") == len(label_sets))
        .select("id", "class_id")
    )


def to_matrix(labels: DataFrame, q: int, ids: DataFrame | None = None) -> DataFrame:
    """Positives -> ``(id, y)``; ``ids`` adds the all-zero rows."""
    packed = labels.groupBy("id").agg(F.collect_set("class_id").alias("held"))
    if ids is not None:
        packed = ids.select("id").join(packed, "id", "left")
    return packed.select("id", dense_labels(F.col("held"), q).alias("y"))


def to_positives(matrix: DataFrame, column: str = "y") -> DataFrame:
    return (
        matrix.select("id", F.posexplode(column).alias("class_id", "flag"))
        .filter(F.col("flag") == 1)
        .select("id", "class_id")
    )


def label_names(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names of the held classes, in class order, joined by a blank."""
    held = F.array_sort(F.collect_set("class_id"))
    return (
        labels.groupBy("id")
        .agg(held.alias("held"))
        .select(
            "id",
            F.array_join(
                F.transform("held", lambda k: index_name(k, names)), " "
            ).alias("labels"),
        )
    )


def has_any(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """Per id, whether it holds any label."""
    held = labels.select("id", F.lit(True).alias("any_label")).distinct()
    return ids.select("id").join(held, "id", "left").select(
        "id", F.coalesce("any_label", F.lit(False)).alias("any_label")
    )


def fallback_labels(new: DataFrame, original: DataFrame) -> DataFrame:
    """Rows that received no label keep their original ones."""
    uncovered = original.join(new.select("id").distinct(), "id", "left_anti")
    return new.select("id", "class_id").unionByName(uncovered.select("id", "class_id"))


def density(labels: DataFrame, n: int | None, q: int, ids: DataFrame | None = None) -> DataFrame:
    """Share of ones in the label matrix."""
    rows = F.lit(n) if n is not None else ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    return labels.agg((F.count(F.lit(1)) / (rows * q)).alias("density"))

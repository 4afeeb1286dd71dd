"""Feature encoding of cleaned catalogue records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manylabel.functions import text as tx
from manylabel.functions.fixed import (
    CATEGORIES,
    CONTENT_KEYS,
    CONTENT_PHRASES,
    PERMISSION_KEYS,
)
from manylabel.functions.lists import map_list, multi_hot, name_index

Encoder = Callable[[Column], list[Column]]


def default_encoders(
    names: Sequence[str] = CATEGORIES,
    content: Sequence[str] = CONTENT_KEYS,
    permissions: Sequence[str] = PERMISSION_KEYS,
) -> dict[str, Encoder]:
    """Column name -> expressions it contributes, in output order."""
    return {
        "Package": lambda c: [c.alias("Package")],
        "Category": lambda c: [name_index(c, names).cast("bigint").alias("Category")],
        "Installs": lambda c: [tx.parse_count(c).alias("Installs")],
        "Content_Feature": lambda c: multi_hot(map_list(c, CONTENT_PHRASES), content),
        "Permission": lambda c: multi_hot(F.split(c, ";"), permissions),
        "Name": lambda c: [tx.letters_only(c).alias("Name")],
        "Description": lambda c: [c.alias("Description")],
    }


def encode(df: DataFrame, encoders: dict[str, Encoder] | None = None) -> DataFrame:
    """Apply the encoder of every known column that is present, then boost the text."""
    encoders = encoders or default_encoders()
    present = [c for c in encoders if c in df.columns]
    out = df.select(*[e for c in present for e in encoders[c](F.col(c))])
    if {"Name", "Description"} <= set(out.columns):
        out = out.withColumn("Description", tx.boost(F.col("Name"), F.col("Description")))
        out = out.drop("Name")
    return out


def binarize(df: DataFrame, class_id: int, column: str = "class_id") -> DataFrame:
    """One-vs-rest target of a single class."""
    return df.withColumn("y", (F.col(column) == class_id).cast("int"))

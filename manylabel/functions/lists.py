"""Expressions over delimited lists and closed vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal_map(pairs: Mapping) -> Column:
    flat = []
    for key, value in pairs.items():
        entry = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        flat += [F.lit(key), entry]
    return F.create_map(*flat)


def map_list(c: Column, mapping: Mapping[str, Sequence[str]], sep: str = ", ") -> Column:
    """Rewrite whole elements of a delimited list through ``mapping``.

    One element may become several keys; unknown elements pass through. The result is
    an array without repeats.
    """
    table = _literal_map({k: list(v) for k, v in mapping.items()})
    parts = F.split(c, sep)
    mapped = F.transform(parts, lambda e: F.coalesce(F.try_element_at(table, e), F.array(e)))
    return F.array_distinct(F.flatten(mapped))


def multi_hot(items: Column, vocabulary: Sequence[str], prefix: str = "") -> list[Column]:
    """One 0/1 byte column per vocabulary key; a missing list gives zeros."""
    return [
        F.coalesce(F.array_contains(items, key), F.lit(False)).cast("tinyint").alias(prefix + key)
        for key in vocabulary
    ]


def ordinal(c: Column, ranks: Mapping[str, int]) -> Column:
    return F.try_element_at(_literal_map(ranks), c)


def name_index(c: Column, names: Sequence[str]) -> Column:
    """Zero-based index of a name; an unknown name fails the job."""
    position = F.array_position(F.array(*map(F.lit, names)), c)
    known = F.when(position > 0, position - 1)
    message = F.concat(F.lit("unknown class name: "), F.coalesce(c, F.lit("null")))
    return F.coalesce(known, F.raise_error(message).cast("bigint")).cast("int")


def index_name(c: Column, names: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))

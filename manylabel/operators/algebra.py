"""The two products every learner is made of, on long feature tables.

``doc_scores`` is ``X B`` (join on the term, sum by document) and ``term_sums`` is
``X' A`` (join on the document, sum by term). All classes or tasks sit side by side in one
array column, so a pass over the features serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manylabel.session import at_ids, block_of, block_width, placed_by_block, stage

# A term table estimated below this many bytes is broadcast as a whole. The driver holds it several
# times over while it is collected, hashed and sent.
BROADCAST_BYTES = 32 << 20
# Otherwise terms holding at least 1/HEAD_TERMS of all rows are broadcast; there can be no
# more than HEAD_TERMS of them, and no term left for the shuffle is frequent.
HEAD_TERMS = 20_000


# Longer terms are never broadcast as frequent ones, which bounds that table in bytes.
MAX_HEAD_TERM = 1024


class TermSize(NamedTuple):
    """Measured size of a per-term table: rows, feature rows behind it, bytes of its keys."""

    terms: int
    pairs: int
    key_bytes: int

    def table_bytes(self, tasks: int) -> int:
        return self.key_bytes + self.terms * (96 + 8 * tasks)


SIZE_COLUMNS = (
    "count(1) AS v", "coalesce(sum(df), 0) AS pairs",
    "coalesce(sum(octet_length(term)), 0) AS key_bytes",
)


def term_size(table: DataFrame) -> TermSize:
    return TermSize(*table.agg(*map(F.expr, SIZE_COLUMNS)).first())


def join_terms(
    rows: DataFrame, table: DataFrame, on: Sequence[str] = ("term",), tasks: int = 1,
    size: TermSize | None = None, broadcast_bytes: int | None = None,
    head_terms: int | None = None, missing: Column | None = None,
) -> DataFrame:
    """Inner join of feature rows with a per-term table that carries ``df``.

    With ``missing``, a struct of the table's other columns, rows in blocks whose term the table does not
    have are kept and get its values.

    A table of checked small size is broadcast. A larger one goes to the blocks of ``rows``, if they
    have any. Else it is split: frequent terms (few by counting) are broadcast, so the bulk of the
    rows stays in place, and only the rows of rare terms are shuffled. ``size`` is the measured size
    of a table that is staged already; without it the table is staged and measured here.
    """
    on = list(on)
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    head = HEAD_TERMS if head_terms is None else head_terms
    if size is None:
        with placed_by_block(rows.sparkSession):
            table = stage(table, "terms")
        size = term_size(table)
    width = tasks + len(table.columns)
    if size.table_bytes(width) <= limit:
        if missing is None:
            return rows.join(F.broadcast(table), on)
        found = rows.join(F.broadcast(_as_struct(table, on, "_top")), on, "left")
        return _unpacked(found, rows, table, on, F.coalesce("_top", missing))
    if block_of(rows.columns):
        return join_blocks(rows, table, on, head_step(table, width, limit), missing)
    if missing is not None:
        raise ValueError("rows without blocks cannot keep terms that are missing")
    short = F.octet_length("term") <= MAX_HEAD_TERM
    frequent = (F.col("df") * F.lit(head) >= F.lit(size.pairs)) & short
    top = F.broadcast(table.filter(frequent))
    rare_rows = rows.join(F.broadcast(table.filter(frequent).select(*on)), on, "left_anti")
    return rows.join(top, on).unionByName(rare_rows.join(table.filter(~frequent), on))


# Steps of the documents of a term, for each doubling.
STEPS = 4


def _step() -> Column:
    return F.floor(F.log2(F.col("df").cast("double")) * STEPS).cast("int")


def head_step(table: DataFrame, width: int, limit: int) -> int | None:
    """The lowest step of ``df`` from which on the rows of ``table`` stay below ``limit`` bytes, if any."""
    sizes = table.groupBy(_step().alias("step")).agg(*map(F.expr, SIZE_COLUMNS))
    held, found = 0, None
    for row in sorted(sizes.collect(), key=lambda r: -r["step"]):  # STEPS rows for each doubling
        held += TermSize(row["v"], row["pairs"], row["key_bytes"]).table_bytes(width)
        if held > limit:
            break
        found = row["step"]
    return found


def _as_struct(table: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    return table.select(*on, F.struct(*[c for c in table.columns if c not in on]).alias(name))


def _unpacked(
    joined: DataFrame, rows: DataFrame, table: DataFrame, on: Sequence[str], found: Column
) -> DataFrame:
    more = [c for c in table.columns if c not in on]
    held = joined.select(*rows.columns, found.alias("_found")).filter(F.col("_found").isNotNull())
    return held.select(*rows.columns, *[F.col("_found").getField(c).alias(c) for c in more])


def join_blocks(
    rows: DataFrame, table: DataFrame, on: Sequence[str] = ("term",), step: int | None = None,
    missing: Column | None = None,
) -> DataFrame:
    """Inner join of rows in blocks with a per-term table: rows stay where they are.

    Each block asks once for every term that it holds and gets that term's row of ``table``. What
    travels grows with the terms of the blocks, not with rows times ids. Terms of many documents, from
    ``step`` on, would go to nearly all blocks; they are broadcast instead. The job that reads the
    result has to run under ``placed_by_block``.
    """
    block, on = block_of(rows.columns), list(on)
    held = rows.select(block, *on).distinct()
    if step is None and missing is None:
        answers = held.join(table, on).repartition(block_width(block), block)
        return rows.join(answers.hint("shuffle_hash"), [block, *on])
    joined, rare = rows, table
    if step is not None:
        top = _as_struct(table.filter(_step() >= step), on, "_top")
        joined, rare = rows.join(F.broadcast(top), on, "left"), table.filter(_step() < step)
        held = held.join(F.broadcast(top.select(*on)), on, "left_anti")
    answers = held.join(_as_struct(rare, on, "_rare"), on).repartition(block_width(block), block)
    joined = joined.join(answers.hint("shuffle_hash"), [block, *on], "left")
    ways = (["_top"] if step is not None else []) + ["_rare"] + ([missing] if missing is not None else [])
    return _unpacked(joined, rows, table, on, F.coalesce(*ways))


def array_sums(value: str, weights: str, tasks: int) -> list[Column]:
    """``_s0, _s1, ...``: sums of the SQL expression ``value`` times each array element."""
    return [F.expr(f"sum({value} * get({weights}, {k})) AS _s{k}") for k in range(tasks)]


def pack(tasks: int, name: str) -> Column:
    """The sums of :func:`array_sums` as one array column."""
    cells = ", ".join(f"coalesce(_s{k}, 0.0D)" for k in range(tasks))
    return F.expr(f"array({cells}) AS {name}")


def doc_scores(
    rows: DataFrame, table: DataFrame, tasks: int, x: str = "x", w: str = "w",
    on: Sequence[str] = ("term",), keys: Sequence[str] = ("id",),
    size: TermSize | None = None,
) -> DataFrame:
    """``(*keys, s)`` with ``s[k] = sum_t x * w[k]``."""
    joined = join_terms(rows, table, on, tasks, size)
    block = block_of(rows.columns)
    inside = [block] if block else []
    summed = joined.groupBy(*inside, *keys).agg(*array_sums(f"CAST({x} AS DOUBLE)", w, tasks))
    packed = summed.select(*keys, pack(tasks, "s"))
    if not block:
        return packed
    with placed_by_block(rows.sparkSession):
        return stage(packed, "scores")


def term_sums(
    rows: DataFrame, docs: DataFrame, tasks: int, x: str = "x", a: str = "a",
    keys: Sequence[str] = ("term",),
) -> DataFrame:
    """``(*keys, df, s)`` with ``s[k] = sum_i x * a[k]`` and ``df`` the rows behind it.

    Map tasks sum per term first, so frequent terms arrive as one row per task.
    """
    joined = rows.join(*at_ids(rows, docs))
    summed = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("df"), *array_sums(f"CAST({x} AS DOUBLE)", a, tasks)
    )
    return summed.select(*keys, "df", pack(tasks, "s"))


def literal_array(values: Sequence[float]) -> Column:
    cells = ", ".join(
        f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)}')" for v in values
    )
    return F.expr(f"array({cells})")

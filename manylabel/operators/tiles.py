"""A sparse matrix in blocks of rows, and its product ``X X'`` with vectors that stay distributed.

A block holds the entries of its rows as numpy arrays in binary columns, with its own numbers for
the terms that occur in it. Vectors over rows are one binary a block; a vector holds one column for
each task (class, fold, parameter). For a product, each block sums over its rows and sends only
the terms it holds, by range of terms; a range sums what it gets and answers each block with just
that block's terms. Blocks never move: their table is bucketed. Terms of a single row need
no exchange at all: they only scale that row.

Sizes of blocks and ranges follow from the numbers of entries, rows, terms and tasks, so a task
holds some tens of megabytes at any size of the matrix, and the driver holds no vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.operators.algebra import TermSize, join_terms, term_size
from manylabel.operators.ranks import with_rank
from manylabel.session import at_ids, block_of, placed_by_block, shuffle_width, stage, stage_by_key, with_block

#: Entries of a block of rows, numbers that it may get back for all columns, and bytes of a piece of a vector.
BLOCK_ENTRIES = 1_000_000
BLOCK_NUMBERS = 32_000_000
PIECE_BYTES = 4 << 20
#: Products that are worth a task of their own, up to the number of cores.
TASK_NUMBERS = 4_000_000
#: Terms of a range at least.
LEAST_SPAN = 1024
#: Parts of a sum that meet in one task, and pieces that a range gets.
FAN = 16
#: Columns of a vector that are multiplied at once.
COLUMNS = 32
#: Binary columns of a block: its terms, entries by term and by row, the scale of each row, and
#: the entries of terms of a single row.
BLOCK = ("ids", "s", "terms", "term_counts", "rows", "by_term", "row_counts", "cols", "by_row", "scale", "lone", "lone_rows", "lone_data")


def matrix(value: pa.Scalar, columns: int) -> np.ndarray:
    """A binary cell as a matrix with ``columns`` columns."""
    return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, columns)


def spread_index(terms: DataFrame) -> tuple[DataFrame, int]:
    """``terms(term, df)`` with a position ``idx``, and the number of terms of several rows.

    Those come first, in the order of a hash, so that ranges get equal shares of the frequent ones.
    """
    order = [(F.col("df") == 1).cast("int"), F.xxhash64("term"), F.col("term")]
    ranked = with_rank(terms, [], order, "_rn").withColumn("idx", F.col("_rn") - 1).drop("_rn")
    return ranked, terms.filter("df > 1").count()


def numbered_entries(features: DataFrame, ids: DataFrame, x: str = "x") -> tuple[DataFrame, TermSize, int]:
    """Entries ``(id, idx, x)`` of the rows ``ids``, in blocks if ``features`` are, what all their terms
    measure, and the number of terms of several rows.

    Terms of a single row share one number after all others, where rows in blocks can do without their own. The
    job that reads the entries has to run under ``placed_by_block``.
    """
    with placed_by_block(features.sparkSession):
        inside = features.join(*at_ids(features, ids.select("id")), "left_semi")
        terms = stage(inside.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "tileterms")
        size, block = term_size(terms), block_of(features.columns)
        numbered, shared = spread_index(terms.filter("df > 1") if block else terms)
        indexed = stage(numbered, "tileindex").select("term", "df", "idx")
        lone = F.struct(F.lit(1).cast("bigint").alias("df"), F.lit(shared).cast("bigint").alias("idx"))
        entries = join_terms(inside, indexed, size=term_size(indexed), missing=lone if block else None)
    return entries.select(*([block] if block else []), "id", "idx", F.col(x).cast("double").alias("x")), size, shared


def _gathered(counts: np.ndarray, of: np.ndarray, data: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``out[i] = sum data * v[of]`` over the ``counts[i]`` entries of ``i``, which follow each other."""
    out = np.zeros((v.shape[1], len(counts)))
    held = np.flatnonzero(counts)
    if len(held):
        starts, near = np.cumsum(counts[held]) - counts[held], np.empty(len(of))
        # Column by column, what is gathered from stays in the processor's caches.
        for column, into in zip(np.ascontiguousarray(v.T), out):
            np.take(column, of, out=near, mode="clip")
            near *= data
            into[held] = np.add.reduceat(near, starts)
    return np.ascontiguousarray(out.T)


class Tiles:
    """Blocks of ``entries(id, idx, x)`` with a last constant column of ones.

    Terms are numbered as :func:`spread_index` does: those below ``shared`` occur in several rows.
    Entries may carry their block. ``rows(id, s)`` names the rows, also those without entries; ``s`` holds a small number for
    each of ``tasks`` tasks. ``self.rows`` is ``(r, n, ids, s)``, one row a block. ``widest`` is the
    number of columns of the widest vector, where that is not ``tasks``.
    """

    def __init__(
        self, entries: DataFrame, rows: DataFrame, terms: int, shared: int, tasks: int, pairs: int, n: int, widest: int = 0,
    ):
        spark = entries.sparkSession
        self.spark, self.tasks, self.terms, self.shared = spark, tasks, terms, shared
        tasks = max(tasks, widest)
        cores, columns = shuffle_width(spark), min(tasks, COLUMNS)
        # Small matrices are cut finer, for all cores, as far as pieces stay worth a task.
        spread = min(cores, -(-(pairs + n) * tasks // TASK_NUMBERS))
        self.blocks = max(spread, -(-(pairs + n) // BLOCK_ENTRIES), -(-(pairs + n) * tasks // BLOCK_NUMBERS), -(-n * tasks * 8 // PIECE_BYTES), 1)
        # Entries in blocks are packed where they are.
        block = block_of(entries.columns)
        on = [block, "id"] if block else ["id"]
        packed = entries.groupBy(*on).agg(F.collect_list("idx").alias("idx"), F.collect_list("x").alias("x"))
        given = rows.select("id", "s")
        whole = (with_block(given, block) if block else given).join(packed, on, "left").select(
            F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int").alias("r"), "id", F.col("s").cast("array<double>").alias("s"),
            F.coalesce("idx", F.array().cast("array<bigint>")).alias("idx"), F.coalesce("x", F.array().cast("array<double>")).alias("x"),
        )

        def cut(table: pa.Table) -> pa.Table:
            table = table.sort_by("id").combine_chunks()
            n = len(table)
            idx, x, s = (table.column(c).combine_chunks() for c in ("idx", "x", "s"))
            row = np.repeat(np.arange(n, dtype=np.int32), idx.value_lengths().to_numpy())
            idx, x = (a.flatten().to_numpy(zero_copy_only=False) for a in (idx, x))
            lone = idx >= shared
            # The constant column comes after the shared terms.
            at = np.concatenate([row[~lone], np.arange(n, dtype=np.int32)])
            terms, local = np.unique(np.concatenate([idx[~lone], np.full(n, shared)]), return_inverse=True)
            data = np.concatenate([x[~lone], np.ones(n)])
            term_order, row_order = np.lexsort([at, local]), np.lexsort([local, at])
            cells = {
                "ids": table.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64),
                "s": s.flatten().to_numpy(zero_copy_only=False).astype(np.int8),
                "terms": terms.astype(np.int64), "term_counts": np.bincount(local, minlength=len(terms)),
                "rows": at[term_order], "by_term": data[term_order], "row_counts": np.bincount(at, minlength=n),
                "cols": local[row_order].astype(np.int32), "by_row": data[row_order],
                "scale": np.bincount(row[lone], x[lone] ** 2, n),
                "lone": idx[lone].astype(np.int64), "lone_rows": row[lone], "lone_data": x[lone],
            }
            first = {"r": table.column("r").slice(0, 1), "n": pa.array([n], pa.int32()), "held": pa.array([len(terms)], pa.int64())}
            return pa.table(first | {c: pa.array([np.ascontiguousarray(cells[c]).tobytes()], pa.binary()) for c in BLOCK})

        schema = "r int, n int, held long, " + ", ".join(f"{c} binary" for c in BLOCK)
        with placed_by_block(spark):
            dealt = whole.repartition(self.blocks, "r").groupBy("r").applyInArrow(cut, schema)
            self.table = stage_by_key(dealt, "r", "tiles", placed=True, width=self.blocks)
        self.rows = self.table.select("r", "n", "ids", "s")
        held = self.table.agg(F.sum("held")).first()[0] or 0
        ranges = max(
            -(-(shared + 1) * columns * 8 // PIECE_BYTES), -(-held * columns * 8 // (FAN * PIECE_BYTES)),
            min(cores, -(-held * columns * FAN // TASK_NUMBERS)), 1,
        )
        self.span = max(LEAST_SPAN, -(-(shared + 1) // ranges))
        self.ranges = -(-(shared + 1) // self.span)

    def _sent(self, rows: DataFrame, columns: Sequence[tuple[int, int]], lone: bool = True) -> DataFrame:
        """``(c, j, r, at, v)``: sums of the terms of each block, by range ``c`` and columns ``j``
        of ``rows(r, v)``. What terms of a single row give comes under ``-1 - r``, zero without ``lone``."""
        span, ranges, width = self.span, self.ranges, columns[-1][1]

        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    cell = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                    r, y, terms, out = batch.column("r")[i].as_py(), matrix(batch.column("v")[i], width), cell("terms", np.int64), []
                    ends = np.searchsorted(terms, np.arange(ranges + 1) * span)
                    for j, (a, b) in enumerate(columns):
                        own = np.ascontiguousarray(y[:, a:b])
                        part = _gathered(cell("term_counts", np.int64), cell("rows", np.int32), cell("by_term", np.float64), own)
                        out.append((-1 - r, j, r, b"", (cell("scale", np.float64)[:, None] * own * lone).tobytes()))
                        for c in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                            near = slice(ends[c], ends[c + 1])
                            out.append((c, j, r, (terms[near] - c * span).astype(np.int32).tobytes(), part[near].tobytes()))
                    kinds = [pa.int32()] * 3 + [pa.binary()] * 2
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["c", "j", "r", "at", "v"])

        block = self.table.select("r", "terms", "term_counts", "rows", "by_term", "scale")
        return block.join(rows.hint("merge"), "r").mapInArrow(multiplied, "c int, j int, r int, at binary, v binary")

    def through(self, rows: DataFrame, columns: int, turn: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """``(r, v)``: ``X X' y`` for ``rows(r, v)`` with ``columns`` columns.

        With ``turn``, it is ``X turn(X' y)``, ``turn`` getting all columns of some terms; the constant column and terms of
        a single row are left out.
        """
        cuts = np.linspace(0, columns, (1 if turn else -(-columns // COLUMNS)) + 1).astype(int).tolist()
        pieces = list(zip(cuts, cuts[1:]))
        span, shared = self.span, self.shared

        def answered(table: pa.Table) -> pa.Table:
            kept = table.select(["r", "j", "c"])
            if table.column("c")[0].as_py() < 0:
                return kept.append_column("v", table.column("v"))
            a, b = pieces[table.column("j")[0].as_py()]
            at = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("at")]
            out = np.zeros((span, b - a))
            for to, v in zip(at, table.column("v")):
                out[to] += matrix(v, b - a)
            if turn:
                out = turn(out)
                out[max(shared - table.column("c")[0].as_py() * span, 0):] = 0.0
            return kept.append_column("v", pa.array([out[to].tobytes() for to in at], pa.binary()))

        def gathered(block: pa.Table, answers: pa.Table) -> pa.Table:
            cell = lambda c, kind: np.frombuffer(block.column(c)[0].as_buffer(), kind)
            got = {(j, c): v for j, c, v in zip(answers.column("j").to_pylist(), answers.column("c").to_pylist(), answers.column("v"))}
            out = np.empty((len(cell("row_counts", np.int64)), columns))
            for j, (a, b) in enumerate(pieces):
                own = sorted((c, v) for (k, c), v in got.items() if k == j)
                v = np.concatenate([matrix(v, b - a) for _, v in own[1:]])
                out[:, a:b] = _gathered(cell("row_counts", np.int64), cell("cols", np.int32), cell("by_row", np.float64), v)
                out[:, a:b] += matrix(own[0][1], b - a)
            return pa.table({"r": block.column("r"), "v": pa.array([out.tobytes()], pa.binary())})

        sums = self._sent(rows, pieces, turn is None).groupBy("c", "j").applyInArrow(answered, "r int, j int, c int, v binary")
        # Answers stay rows of their own: joined into one row with the block, executors would hold it many times.
        back = sums.repartition(self.blocks, "r").groupBy("r")
        block = self.table.select("r", "row_counts", "cols", "by_row")
        return block.groupBy("r").cogroup(back).applyInArrow(gathered, "r int, v binary")

    def turned(self, rows: DataFrame, columns: int) -> DataFrame:
        """``(idx, w)``: ``X' a`` of every term for ``rows(r, v)``; the constant comes last."""
        span, shared, terms = self.span, self.shared, self.terms

        def listed(idx: np.ndarray, w: np.ndarray) -> dict:
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * columns)
            return {"idx": pa.array(idx, pa.int64()), "w": pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))}

        def add(table: pa.Table) -> pa.Table:
            c = table.column("c")[0].as_py()
            out = np.zeros((min(span, shared + 1 - c * span), columns))
            for at, v in zip(table.column("at"), table.column("v")):
                out[np.frombuffer(at.as_buffer(), np.int32)] += matrix(v, columns)
            idx = c * span + np.arange(len(out))
            return pa.table(listed(np.where(idx == shared, terms, idx), out))

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    cell = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                    w = matrix(batch.column("v")[i], columns)[cell("lone_rows", np.int32)] * cell("lone_data", np.float64)[:, None]
                    yield pa.record_batch(listed(cell("lone", np.int64), w))

        schema = "idx long, w array<double>"
        several = self._sent(rows, [(0, columns)]).filter("c >= 0").groupBy("c").applyInArrow(add, schema)
        block = self.table.select("r", "lone", "lone_rows", "lone_data")
        return several.unionByName(block.join(rows.hint("merge"), "r").mapInArrow(alone, schema))


def total(parts: DataFrame, key: str, count: int, width: int = 0) -> DataFrame:
    """``(key, v)``: sums of the parts ``(key, part, v)`` of each key, at most ``FAN`` at once.

    ``width`` is the number of partitions that the parts are dealt to, where it is given; later rounds have fewer parts.
    """

    def add(table: pa.Table) -> pa.Table:
        column = table.column("v")
        out = np.frombuffer(column[0].as_buffer(), np.float64).copy()
        for i in range(1, len(column)):
            out += np.frombuffer(column[i].as_buffer(), np.float64)
        first = table.slice(0, 1).select([key, "part"])
        return first.append_column("v", pa.array([out.tobytes()], pa.binary()))

    while count > 1:
        count = -(-count // FAN)
        grouped = parts.withColumn("part", F.col("part") % F.lit(count))
        if width:
            grouped, width = grouped.repartition(width, key, "part"), -(-width // FAN)
        parts = grouped.groupBy(key, "part").applyInArrow(add, f"{key} int, part int, v binary")
    return parts.select(key, "v")


def map_blocks(df: DataFrame, key: str, names: Sequence[str], work: Callable, sums: bool = False) -> DataFrame:
    """Apply ``work(row)``, which returns a dict of matrices ``names``, to every row of binaries.

    With ``sums``, ``work`` also returns a list of numbers under ``sums``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                out = work(row)
                cells = {key: pa.array([row[key].as_py()], pa.int32())}
                cells |= {n: pa.array([np.ascontiguousarray(out[n]).tobytes()], pa.binary()) for n in names}
                if sums:
                    flat = [float(x) for x in np.concatenate([np.ravel(v) for v in out["sums"]])]
                    cells["sums"] = pa.array([flat], pa.list_(pa.float64()))
                yield pa.record_batch(cells)

    kinds = [f"{key} int", *(f"{n} binary" for n in names), *(["sums array<double>"] if sums else [])]
    return df.mapInArrow(run, ", ".join(kinds))


def summed(state: DataFrame, tasks: int) -> np.ndarray:
    """The summed numbers of all pieces, a row for each kind and a column for each task."""
    found = state.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["i"] for r in found), default=-1) + 1)
    for r in found:
        out[r["i"]] = r["v"]
    return out.reshape(-1, tasks)

"""Multinomial naive Bayes for all classes in one pass.

Counts of the complement of a class are the overall counts minus those of the class, so
any number of one-vs-rest fits costs one aggregate by term. Scores are log-odds margins,
which do not underflow; they are rounded before any comparison so that exact copies of a
text compare equal whatever the summation order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manylabel.operators.algebra import (
    SIZE_COLUMNS,
    TermSize,
    array_sums,
    doc_scores,
    literal_array,
    pack,
)
from manylabel.operators.tiles import Tiles, map_blocks, matrix, numbered_entries, summed
from manylabel.session import at_ids, placed_by_block, stage

DIGITS = 6


@dataclass
class BayesModel:
    """Per-term weights ``(term, df, w)`` and one constant per class."""

    weights: DataFrame
    prior: list[float]
    size: TermSize

    @property
    def tasks(self) -> int:
        return len(self.prior)


def nb_stats(counts: DataFrame, y: DataFrame, q: int, x: str = "tf") -> DataFrame:
    """``(term, df, n, nk)``: occurrences per term, overall and per class.

    ``y`` is ``(id, y)`` with a 0/1 array; documents outside it are not counted.
    """
    joined = counts.join(*at_ids(counts, y.select("id", "y")))
    summed = joined.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.col(x).cast("double")).alias("n"),
        *array_sums(f"CAST({x} AS DOUBLE)", "y", q)
    )
    return summed.select("term", "df", "n", pack(q, "nk"))


def class_totals(y: DataFrame, q: int) -> tuple[int, list[float]]:
    """Number of documents, overall and per class: ``q + 1`` numbers."""
    row = y.agg(F.count(F.lit(1)).alias("n"), *array_sums("1.0D", "y", q)).first()
    return row["n"], [row[f"_s{k}"] or 0.0 for k in range(q)]


def _log(value: float) -> float:
    return math.log(value) if value > 0 else float("-inf")


@dataclass
class Totals:
    """Sums over all terms: table size, occurrences overall and per class."""

    size: TermSize
    n: float
    nk: list[float]


def _term_totals(stats: DataFrame, q: int) -> Totals:
    row = stats.agg(
        *map(F.expr, SIZE_COLUMNS), F.sum("n").alias("n"), *array_sums("1.0D", "nk", q),
    ).first()
    per_class = [row[f"_s{k}"] or 0.0 for k in range(q)]
    size = TermSize(row["v"], row["pairs"], row["key_bytes"])
    return Totals(size, row["n"] or 0.0, per_class)


def fit_binary(
    counts: DataFrame, y: DataFrame, q: int, alpha: float = 1.0, x: str = "tf",
    totals: tuple[int, list[float]] | None = None,
) -> BayesModel:
    """One-vs-rest fits of all ``q`` classes; scores are log-odds margins.

    ``totals`` are the :func:`class_totals` of ``y`` if the caller has them.
    """
    with placed_by_block(counts.sparkSession):
        stats = stage(nb_stats(counts, y, q, x), "nb")
    sums = _term_totals(stats, q)
    n, positives = totals or class_totals(y, q)
    smooth = alpha * sums.size.terms
    shift = literal_array([_log(c + smooth) - _log(sums.n - c + smooth) for c in sums.nk])
    weights = stats.select(
        "term", "df",
        F.zip_with(
            "nk", shift,
            lambda c, s: F.log(c + alpha) - F.log(F.col("n") - c + alpha) - s,
        ).alias("w"),
    )
    return BayesModel(weights, _prior(n, positives), sums.size)


def _prior(n: int, positives: Sequence[float]) -> list[float]:
    """Log odds of each class among ``n`` rows."""
    return [
        _log(p) - _log(n - p) if 0 < p < n else math.copysign(float("inf"), p - n / 2)
        for p in positives
    ]


def fit_multiclass(
    counts: DataFrame, y: DataFrame, q: int, alpha: float | Sequence[float] = 1.0,
    x: str = "tf",
) -> BayesModel:
    """Joint log likelihood of all classes; predict with :func:`best_class`.

    Several values of ``alpha`` share one pass over the counts: their weights follow each
    other, ``q`` per value.
    """
    alphas = [alpha] if isinstance(alpha, (int, float)) else list(alpha)
    with placed_by_block(counts.sparkSession):
        stats = stage(nb_stats(counts, y, q, x), "nb")
    sums = _term_totals(stats, q)
    n, sizes = class_totals(y, q)

    def weights(a: float) -> Column:
        shift = literal_array([_log(c + a * sums.size.terms) for c in sums.nk])
        return F.zip_with("nk", shift, lambda c, s: F.log(c + a) - s)

    table = stats.select("term", "df", F.concat(*map(weights, alphas)).alias("w"))
    prior = [_log(s) - _log(n) for s in sizes] * len(alphas)
    return BayesModel(table, prior, sums.size)


def score(model: BayesModel, counts: DataFrame, ids: DataFrame, x: str = "tf") -> DataFrame:
    """``(id, m)`` rounded scores; documents without any known term keep the prior."""
    sums = doc_scores(counts, model.weights, model.tasks, x, size=model.size)
    prior = literal_array(model.prior)
    empty = literal_array([0.0] * model.tasks)
    return ids.select("id").join(sums, "id", "left").select(
        "id",
        F.zip_with(
            F.coalesce("s", empty), prior, lambda s, p: F.round(s + p, DIGITS)
        ).alias("m"),
    )


class CountTiles:
    """Counts in tiles, for margins of one-vs-rest fits that are scored on the rows they are fitted on.

    Sums by term and weights never become rows: each block of documents sends the sums of its terms and
    gets their weights. ``side`` holds the length of each document, and what its own terms weigh where it is a positive; they
    weigh as much against the class where it is not.
    """

    def __init__(self, counts: DataFrame, ids: DataFrame, q: int, alpha: float):
        entries, self.size, shared = numbered_entries(counts, ids, "tf")
        rows = ids.select("id", F.array(F.lit(0)).alias("s"))
        self.alpha = alpha
        self.tiles = Tiles(entries, rows, self.size.terms, shared, q + 1, self.size.pairs, ids.count())

        def measure(row: dict) -> dict:
            cell = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)
            held, lone, n = cell("row_counts", np.int64), cell("lone_data", np.float64), row["n"].as_py()
            at, own = cell("lone_rows", np.int32), lone * (np.log(lone + alpha) - math.log(alpha))
            shared = np.bincount(np.repeat(np.arange(n), held), cell("by_row", np.float64), n) - 1.0  # without the constant
            return {"length": shared + np.bincount(at, lone, n), "own": np.bincount(at, own, n)}

        columns = ("r", "n", "row_counts", "by_row", "lone_rows", "lone_data")
        self.side = stage(map_blocks(self.tiles.table.select(*columns), "r", ("length", "own"), measure), "side")

    def margins(self, y: DataFrame, q: int, totals: tuple[int, list[float]]) -> DataFrame:
        """``(id, m)``, as :func:`score` gives after :func:`fit_binary`, for the targets ``y(id, y)`` of all rows."""
        tiles, alpha, smooth = self.tiles, self.alpha, self.alpha * self.size.terms

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("id").combine_chunks()
            y = table.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, q).astype(np.float64)
            cell = np.hstack([np.ones((len(y), 1)), y]).tobytes()
            return pa.table({"r": table.column("r").slice(0, 1), "y": pa.array([cell], pa.binary())})

        r = F.pmod(F.xxhash64("id"), F.lit(tiles.blocks)).cast("int").alias("r")
        packed = stage(y.select(r, "id", "y").groupBy("r").applyInArrow(pack, "r int, y binary"), "packed")

        def tokens(row: dict) -> dict:
            return {"sums": [matrix(row["length"], 1).T @ matrix(row["y"], q + 1)]}

        known = packed.join(self.side, "r")
        n, *nk = summed(map_blocks(known, "r", (), tokens, sums=True), q + 1)[0].tolist()
        shift = np.array([_log(n - c + smooth) - _log(c + smooth) for c in nk])
        prior = np.array(_prior(*totals))

        def weigh(sums: np.ndarray) -> np.ndarray:
            own = sums[:, 1:]
            return np.hstack([np.zeros((len(sums), 1)), np.log(own + alpha) - np.log(sums[:, :1] - own + alpha)])

        def add(row: dict) -> dict:
            y, length, own = matrix(row["y"], q + 1)[:, 1:], matrix(row["length"], 1), matrix(row["own"], 1)
            return {"m": np.round(matrix(row["v"], q + 1)[:, 1:] + own * (2.0 * y - 1.0) + length * shift + prior, DIGITS) + 0.0}

        through = tiles.through(packed.withColumnRenamed("y", "v"), q + 1, weigh)
        found = map_blocks(known.join(through, "r"), "r", ("m",), add)

        def listed(batches):
            for batch in batches:
                for i in range(len(batch)):
                    m, ids = matrix(batch.column("m")[i], q), np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                    ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * q)
                    yield pa.record_batch({"id": ids, "m": pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1)))})

        return tiles.rows.select("r", "ids").join(found, "r").mapInArrow(listed, "id long, m array<double>")


def positive(margins: str = "m") -> Column:
    """0/1 array of positive margins; a tie is negative."""
    return F.transform(margins, lambda m: (m > 0).cast("tinyint"))


def best_class(scores: str = "m") -> Column:
    """Class of the largest score; ties go to the lowest class."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

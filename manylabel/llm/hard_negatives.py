"""Hard negatives by exact inner-product search over lists that clusters of anchors share.

Anchors are grouped around centres fitted on a bounded sample of them. For an anchor ``u`` at most
``spread`` away (in angle) from its centre, no row ``i`` scores above
``|u| |i| cos(max(0, angle(i, centre) - spread))``. A cluster's list holds all rows in falling
order of that bound without ``|u|``; it is made once for the cluster and every member walks it,
until the next bound proves that nothing later can enter the member's result.

On Spark a list is walked in stretches. Counts of bounds per cluster, in steps of the bound, give
the bound at which a stretch ends; a stretch holds four times the rows of those before it. Only
clusters with members still walking send rows, cut into blocks by a hash of the id (a third of
the rows may carry one label or be one vector), and only members still walking meet them. Each
block is sorted by the bound and walked in steps until its members are done; a member keeps its
few best of every block, which are merged between stretches.

A first walk finds each anchor's positives: the best rows of its own label. A second one finds, for
each positive, the best rows of other labels whose score lies between two shares of the positive's.
Scores are integer inner products of the components as ``floor(scale * x)``, compared exactly.

Defined results: rows with a null id or label, a null or empty vector, or a null or non-finite
component take no part, nor do vectors whose squared length overflows a double; rows only meet rows
of the same length; of rows that repeat an id the least by label and vector counts; ties go to the
smaller id; an empty table, or one without anchors, gives an empty result; columns not named take
no part. Products of norms from 2**53 on are multiplied as whole numbers, and scores that a long
cannot hold stop at its bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manylabel.llm.tree_search import _kmeans, matrix
from manylabel.session import drop_staged, made, stage, staging

#: Rows of a list block, and members of a cluster that meet it at once.
BLOCK = 4096
#: Rows of the first stretch of a list; each next stretch is four times all before.
STRETCH = 8192
#: Rows that members walk between two looks at the bound.
STEP = 256
#: Steps in which the bounds of a cluster are counted.
LEVELS = 1024
#: Relative room left to rounding of the bound, which is no part of a score.
ROOM = 1e-9
#: Largest score.
TOP = (1 << 63) - 1


def _bounds(x: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Bound of each row for unit members of each cluster: ``(rows, clusters)``."""
    size = np.sqrt((x * x).sum(axis=1))
    cosine = (x @ centres.T) / np.where(size > 0, size, 1.0)[:, None]
    angle = np.arccos(np.clip(cosine, -1.0, 1.0)) - spread[None, :]
    return size[:, None] * np.cos(np.clip(angle, 0.0, np.pi))


def _scores(members: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    sizes = np.sqrt((members**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
    large = sizes >= 2.0**53
    out = np.where(large, 0.0, members @ rows.T).astype(np.int64)
    for i, j in zip(*np.nonzero(large)):
        exact = sum(int(a) * int(b) for a, b in zip(members[i].tolist(), rows[j].tolist()))
        out[i, j] = max(-TOP, min(TOP, exact))
    return out


def prepared(vectors: DataFrame, anchors: Column, label: Column, key: str, column: str, scale: float) -> DataFrame:
    """``(id, label, vector, width, asked)``: usable rows, each id once, with whole components."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.lit(float(scale)) * v.cast("double"))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
            widths = column.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            vector = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "vector": vector, "width": widths, "asked": batch.column("asked")})

    floored = rows.mapInArrow(floors, "id long, label long, vector array<double>, width int, asked boolean")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    row = F.struct("label", "vector", "width", "asked")
    return floored.filter(squares < float("inf")).groupBy("id").agg(F.min(row).alias("row")).select("id", "row.*")


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each vector length in a batch."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, matrix(batch.column("vector").take(pa.array(rows)))


@dataclass
class Shape:
    """Centres of each vector length, numbered from ``first``, the spread of each cluster around
    its centre, and the largest norm of all rows."""

    centres: dict[int, np.ndarray]
    first: dict[int, int]
    spread: np.ndarray
    top: float = 1.0

    def over(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Row numbers, first cluster and bounds of each vector length that has anchors."""
        for rows, x in _by_width(batch):
            width = x.shape[1]
            if width in self.first:
                a = self.first[width]
                yield rows, a, _bounds(x, self.centres[width], self.spread[a : a + len(self.centres[width])])

    def level(self, bound: np.ndarray) -> np.ndarray:
        """Step of each bound, 0 for the highest."""
        at = np.floor((self.top - bound) / (2 * self.top) * LEVELS).astype(np.int64)
        return np.clip(at, 0, LEVELS - 1)

    def ceiling(self, level: int) -> float:
        """No bound of this step or later ones lies above it."""
        return self.top * (1 - 2 * level / LEVELS)


class Lists:
    """Clusters of anchors and what their lists need: their shape and the counts of bounds.

    Everything held here is bounded by ``clusters`` a vector length, not by the table.
    """

    def __init__(self, rows: DataFrame, anchors: DataFrame, n_anchors: int, sample_rows: int, per_cluster: int, clusters: int):
        self.rows, spark = rows, rows.sparkSession
        share = min(1.0, sample_rows / max(n_anchors, 1))
        drawn = anchors.filter(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
        sample = drawn.select("vector", "width").limit(2 * sample_rows).toArrow().combine_chunks()
        rng = np.random.default_rng(9)
        widths = [r["width"] for r in anchors.select("width").distinct().collect()]
        centres: dict[int, np.ndarray] = {}
        for width in widths:
            at = np.flatnonzero(sample.column("width").to_numpy() == width)
            x = matrix(sample.column("vector").take(pa.array(at))) if len(at) else np.ones((1, width))
            norm = np.sqrt((x * x).sum(axis=1))
            x = x[norm > 0] / norm[norm > 0][:, None]
            k = int(min(clusters, max(1, n_anchors // per_cluster), max(len(x), 1)))
            if len(x) > k > 1:
                group = _kmeans(x, k, rng)
                total = np.array([x[group == g].sum(axis=0) for g in np.unique(group)])
            else:
                total = x.sum(axis=0, keepdims=True) if len(x) else np.ones((1, width))
            norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
            centres[width] = np.where(norm > 0, total, 1.0) / np.where(norm > 0, norm, np.sqrt(width))
        first = np.cumsum([0, *(len(centres[w]) for w in widths)])
        self.n, self.spark = int(first[-1]), spark
        self.shape = Shape(centres, dict(zip(widths, first[:-1].tolist())), np.zeros(self.n))

    def place(self, anchors: DataFrame) -> DataFrame:
        """Anchors with ``cluster``, ``norm`` and ``angle`` to their centre; then the spreads."""
        centres, first = self.shape.centres, self.shape.first

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, norm, angle = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
                for rows, x in _by_width(batch):
                    width = x.shape[1]
                    norm[rows] = np.sqrt((x * x).sum(axis=1))
                    cosine = (x @ centres[width].T) / np.where(norm[rows] > 0, norm[rows], 1.0)[:, None]
                    best = cosine.argmax(axis=1)
                    cluster[rows] = first[width] + best
                    top = np.clip(cosine[np.arange(len(rows)), best], -1.0, 1.0)
                    angle[rows] = np.where(norm[rows] > 0, np.arccos(top), 0.0)
                yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names}, "cluster": cluster, "norm": norm, "angle": angle})

        kind = "id long, label long, vector array<double>, width int, cluster long, norm double, angle double"
        members = stage(anchors.mapInArrow(placed, kind), "members")
        for r in members.groupBy("cluster").agg(F.max("angle").alias("a")).collect():  # clusters
            self.shape.spread[r["cluster"]] = r["a"] + 1e-7
        self._count()
        return members

    def _count(self) -> None:
        top = self.rows.select(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)))).first()[0] or 0.0
        self.shape.top = max(top, 1.0) * (1 + 1e-12)
        shape, n = self.shape, self.n

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((n, LEVELS), np.int64)
            for batch in batches:
                for _, a, bound in shape.over(batch):
                    for j in range(bound.shape[1]):
                        seen[a + j] += np.bincount(shape.level(bound[:, j]), minlength=LEVELS)
            c, at = np.nonzero(seen)
            yield pa.record_batch({"cluster": c.astype(np.int64), "level": at.astype(np.int64), "n": seen[c, at]})

        shell = self.rows.mapInArrow(counted, "cluster long, level long, n long")
        self.counts = np.zeros((self.n, LEVELS), np.int64)
        for r in shell.groupBy("cluster", "level").agg(F.sum("n").alias("n")).collect():  # clusters times levels
            self.counts[r["cluster"], r["level"]] = r["n"]

    def walk(self, members: DataFrame, work, found: str, merge, same_label: bool) -> DataFrame | None:
        """Walk the lists in stretches until no member is left.

        ``members`` carries ``bar``, the score below which nothing helps it (null: any helps).
        ``work(members, rows)`` gives rows ``found``; ``merge(results, fresh, members)`` stages
        the kept results and the members with their new bars.
        """
        done = np.zeros(self.n, np.int64)
        before = np.concatenate([np.zeros((self.n, 1), np.int64), self.counts.cumsum(axis=1)], axis=1)
        results, size, waiting, old = None, STRETCH, members, []
        while True:
            ceilings = F.array(*[F.lit(self.shape.ceiling(int(d))) for d in done])
            left = F.array(*[F.lit(bool(d < LEVELS)) for d in done])
            at = F.col("cluster").cast("int")
            reach = F.col("norm") * F.get(ceilings, at)
            near = reach + F.abs(reach) * F.lit(ROOM) + F.lit(1e-6) >= F.col("bar")
            waiting = waiting.filter(F.get(left, at) & (F.col("bar").isNull() | near))
            held = {r["cluster"]: r["n"] for r in waiting.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
            if not held:
                for path, name in old:
                    made(path, name)
                return results
            ends = done.copy()
            for c in held:
                last = int(np.searchsorted(before[c], before[c, done[c]] + size, "left"))
                few = before[c, -1] - before[c, last if last <= LEVELS else -1] <= size // 4
                ends[c] = LEVELS if few else min(max(last, done[c] + 1), LEVELS)
            fresh = self._stretch(waiting, held, done, ends, before, work, found, same_label)
            with staging() as new:
                results, waiting = merge(results, fresh, waiting)
            drop_staged(self.spark, old)
            done, size, old = ends, size * 4, new

    def _stretch(self, waiting, held, done, ends, before, work, found, same_label) -> DataFrame:
        count = np.array([before[c, ends[c]] - before[c, done[c]] for c in range(self.n)])
        blocks = np.maximum(1, -(-count // BLOCK))
        chunks = np.array([-(-held.get(c, 0) // BLOCK) for c in range(self.n)])
        shape, start, stop = self.shape, done.copy(), ends.copy()

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, a, bound in shape.over(batch):
                    for j in range(bound.shape[1]):
                        c = a + j
                        if not chunks[c]:
                            continue
                        at = shape.level(bound[:, j])
                        inside = np.flatnonzero((at >= start[c]) & (at < stop[c]))
                        if len(inside):
                            part = batch.take(pa.array(rows[inside]))
                            yield pa.record_batch({
                                "id": part.column("id"), "label": part.column("label"), "vector": part.column("vector"),
                                "cluster": np.full(len(inside), c, np.int64), "bound": bound[inside, j],
                                "blocks": np.full(len(inside), blocks[c], np.int32), "chunks": np.full(len(inside), chunks[c], np.int32),
                            })

        kind = "id long, label long, vector array<double>, cluster long, bound double, blocks int, chunks int"
        listed = self.rows.mapInArrow(sent, kind)
        place = ["cluster", "block", "chunk"]
        block = F.pmod(F.xxhash64(F.lit(3), "id", "label"), F.col("blocks")).cast("int")
        if same_label:
            place.insert(1, "label")
            listed = listed.join(waiting.select("cluster", "label").distinct(), ["cluster", "label"], "left_semi")
        listed = listed.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        numbers = F.array(*[F.lit(int(b)) for b in blocks]), F.array(*[F.lit(int(max(c, 1))) for c in chunks])
        mine = F.pmod(F.xxhash64(F.lit(5), "id"), F.get(numbers[1], F.col("cluster").cast("int"))).cast("int")
        walking = waiting.withColumn("chunk", mine).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.get(numbers[0], F.col("cluster").cast("int")) - 1))
        )
        return listed.groupBy(*place).cogroup(walking.groupBy(*place)).applyInArrow(
            lambda rows, members: work(members.combine_chunks(), rows.combine_chunks()), found
        )


def _in_steps(members: pa.Table, rows: pa.Table, bars: np.ndarray, take) -> None:
    """Walk rows by falling bound; ``take(alive, scores, rows)`` returns the new bars of the alive."""
    order = np.argsort(-rows.column("bound").to_numpy(), kind="stable")
    bound = rows.column("bound").to_numpy()[order]
    x, u, norm = matrix(rows.column("vector"))[order], matrix(members.column("vector")), members.column("norm").to_numpy()
    alive = np.arange(len(u))
    for a in range(0, len(x), STEP):
        reach = norm[alive] * bound[a]
        alive = alive[reach + np.abs(reach) * ROOM + 1e-6 >= bars[alive]]
        if not len(alive):
            return
        part = np.arange(a, min(a + STEP, len(x)))
        bars[alive] = take(alive, _scores(u[alive], x[part]), order[part])


def _positives(k: int):
    """Each member's ``k`` best rows of its label in one block."""
    kind = "id long, positive_id long, positive_score long"

    def work(members: pa.Table, rows: pa.Table) -> pa.Table:
        held = [[] for _ in range(len(members))]
        if len(members) and len(rows):
            own, ids = members.column("id").to_numpy(), rows.column("id").to_numpy()
            bars = members.column("bar").to_numpy(zero_copy_only=False).astype(np.float64)
            bars = np.where(np.isnan(bars), -np.inf, bars)

            def take(alive, scores, at):
                new = bars[alive]
                for i, m in enumerate(alive.tolist()):
                    good = np.flatnonzero((scores[i] >= new[i] - abs(new[i]) * 1e-12) & (ids[at] != own[m]))
                    held[m] = sorted(held[m] + [(-int(scores[i, j]), int(ids[at[j]])) for j in good])[:k]
                    if len(held[m]) == k:
                        new[i] = max(new[i], -held[m][-1][0])
                return new

            _in_steps(members, rows, bars, take)
        found = [(int(i), v, -s) for i, h in zip(members.column("id").to_pylist(), held) for s, v in h]
        ids, vs, scores = zip(*found) if found else ((), (), ())
        return pa.table({"id": pa.array(ids, pa.int64()), "positive_id": pa.array(vs, pa.int64()), "positive_score": pa.array(scores, pa.int64())})

    return work, kind


def _negatives(k: int):
    """Each member's ``k`` best rows of other labels in each window ``[low, high]``, in one block."""
    kind = "id long, positive_score long, negative_id long, negative_score long"

    def work(members: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(members) and len(rows):
            own, ids = members.column("id").to_numpy(), rows.column("id").to_numpy()
            label, theirs = members.column("label").to_numpy(), rows.column("label").to_numpy()
            windows = members.column("windows").to_pylist()
            held = [[[] for _ in w] for w in windows]
            bars = members.column("bar").to_numpy(zero_copy_only=False).astype(np.float64)

            def take(alive, scores, at):
                new = bars[alive]
                for i, m in enumerate(alive.tolist()):
                    other = (theirs[at] != label[m]) & (ids[at] != own[m])
                    least = np.inf
                    for n, w in enumerate(windows[m]):
                        got, floor = held[m][n], max(w["low"], w["bar"] if w["bar"] is not None else w["low"])
                        if len(got) == k:
                            floor = max(floor, -got[-1][0])
                        good = np.flatnonzero(other & (scores[i] >= floor) & (scores[i] <= w["high"]))
                        if len(good):
                            held[m][n] = got = sorted(got + [(-int(scores[i, j]), int(ids[at[j]])) for j in good])[:k]
                            if len(got) == k:
                                floor = max(floor, -got[-1][0])
                        least = min(least, floor)
                    new[i] = max(new[i], least)
                return new

            _in_steps(members, rows, bars, take)
            out = [
                (int(i), w["positive_score"], v, -s)
                for i, ws, h in zip(own, windows, held) for w, got in zip(ws, h) for s, v in got
            ]
        columns = list(zip(*out)) if out else [(), (), (), ()]
        names = ("id", "positive_score", "negative_id", "negative_score")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return work, kind


def _first(df: DataFrame, keys: list[str], score: str, partner: str, k: int) -> DataFrame:
    """The ``k`` best partners of each key, each once."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), partner)
    return df.dropDuplicates([*keys, partner, score]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | str = "label", key: str = "vec_id", column: str = "embedding",
    n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    sample_rows: int = 8192, per_cluster: int = 512, clusters: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on the columns of ``vectors``. ``low`` and ``high`` are hundredths of
    the positive's score. At most ``clusters`` centres are fitted on about ``sample_rows`` anchors.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = stage(prepared(vectors, anchors, label, key, column, scale), "vectors")
    asked = rows.filter("asked").drop("asked")
    n = asked.count()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    lists = Lists(rows.drop("asked"), asked, n, sample_rows, per_cluster, clusters)
    members = lists.place(asked)

    def keep_positives(results, fresh, waiting):
        every = fresh if results is None else results.unionByName(fresh)
        best = stage(_first(every, ["id"], "positive_score", "positive_id", n_positives).drop("rank"), "positives")
        bars = best.groupBy("id").agg(F.count(F.lit(1)).alias("got"), F.min("positive_score").alias("least"))
        bar = F.when(F.col("got") == n_positives, F.col("least").cast("double")).alias("bar")
        known = waiting.drop("bar").join(bars, "id", "left")
        return best, stage(known.select(*[c for c in waiting.columns if c != "bar"], bar), "waiting")

    first = members.withColumn("bar", F.lit(None).cast("double"))
    positives = lists.walk(first, *_positives(n_positives), keep_positives, True)

    # Of a score 100 a + b: no product of the score itself, which might not fit a long.
    part = "positive_score div 100 * {0} + (positive_score % 100 * {0} + {1}) div 100 AS {2}"
    windows = positives.filter("positive_score >= 0").select("id", "positive_score").distinct().selectExpr(
        "id", "positive_score", part.format(low, 99, "low"), part.format(high, 0, "high"), "CAST(NULL AS long) AS bar"
    ).filter("low <= high").groupBy("id").agg(
        F.collect_list(F.struct("positive_score", "low", "high", "bar")).alias("windows")
    )
    least = F.array_min(F.transform("windows", lambda w: F.coalesce(w["bar"], w["low"]))).cast("double")

    def keep_negatives(results, fresh, waiting):
        every = fresh if results is None else results.unionByName(fresh)
        best = stage(_first(every, ["id", "positive_score"], "negative_score", "negative_id", n_negatives).drop("rank"), "negatives")
        full = best.groupBy("id", "positive_score").agg(F.count(F.lit(1)).alias("got"), F.min("negative_score").alias("least"))
        bars = full.filter(F.col("got") == n_negatives).groupBy("id").agg(
            F.map_from_entries(F.collect_list(F.struct("positive_score", "least"))).alias("bars")
        )
        known = F.transform("windows", lambda w: w.withField("bar", F.coalesce(F.element_at("bars", w["positive_score"]), w["bar"])))
        after = waiting.join(bars, "id", "left").withColumn("windows", known).drop("bars").withColumn("bar", least)
        return best, stage(after, "waiting")

    second = stage(members.join(windows, "id").withColumn("bar", least), "waiting")
    negatives = lists.walk(second, *_negatives(n_negatives), keep_negatives, False)
    if negatives is None:
        return empty
    ranked = _first(negatives, ["id", "positive_score"], "negative_score", "negative_id", n_negatives)
    return positives.join(ranked, ["id", "positive_score"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )

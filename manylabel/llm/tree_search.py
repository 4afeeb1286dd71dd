"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a sample of bounded size and holds at most ``max_leaves`` leaves, so it is
broadcast; every row of the table is placed in a leaf. A query walks the tree best bin first: a
priority queue holds the branches not yet entered, the most similar centre comes next. How many
leaves a query visits is calibrated: for a bounded sample of queries the exact neighbours are
found by one pass over all rows, and visits are widened until the sample's recall is reached.

Leaves are searched as blocks. A leaf with many rows (one vector may be a third of the table) is
cut into blocks by a hash of the id, and many queries into chunks, so no task holds more than a
block of rows and a chunk of queries. Each query keeps its best few in each block.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part;
ties go to the smaller id; rows of one id should hold one vector and count once, as queries and as
neighbours (of several query vectors under one id the least counts); vectors of different lengths
are not compared, each length is searched with a tree of its own; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Scores this close are ranked again with the exact measure.
NEAR = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has a direction: not null, no null or non-finite component, not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(x.isNotNull() & finite & F.exists(x, lambda v: v != 0))


@dataclass
class Tree:
    """Node 0 is the root. ``children[i]`` is empty for leaves; ``leaf[i]`` is a leaf's number."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each unit vector."""
        node = np.zeros(len(x), np.int64)
        todo = [0] if len(x) else []
        while todo:
            at = todo.pop()
            below = self.children[at]
            rows = np.flatnonzero(node == at)
            if len(below) and len(rows):
                node[rows] = below[(x[rows] @ self.centres[below].T).argmax(axis=1)]
                todo += below.tolist()
        return self.leaf[node]

    def visits(self, x: np.ndarray, limit: int | None = None) -> list[list[int]]:
        """For each unit vector, the leaves in best-bin-first order, ``limit`` of them at most."""
        near = -(x @ self.centres.T)
        out = []
        for row in near:
            row = row.tolist()
            queue, found = [(row[0], 0)], []
            while queue and (limit is None or len(found) < limit):
                _, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    found.append(int(self.leaf[node]))
                for child in self.children[node].tolist():
                    heapq.heappush(queue, (row[child], child))
            out.append(found)
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Group of each row after a few rounds of spherical k-means."""
    centres = x[rng.choice(len(x), k, replace=False)]
    group = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        group = (x @ centres.T).argmax(axis=1)
        for j in np.unique(group):
            total = x[group == j].sum(axis=0)
            size = np.sqrt(total @ total)
            if size > 0:
                centres[j] = total / size
    return group


def build_tree(sample: np.ndarray, branching: int = 8, leaf_rows: int = 64, max_leaves: int = 1024, seed: int = 1) -> Tree:
    """A tree over unit vectors; nodes are split from the largest down."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    centres, children, members = [np.zeros(width)], [np.zeros(0, np.int64)], {0: np.arange(len(sample))}
    queue, leaves = [(-len(sample), 0)], 1
    while queue and leaves + branching - 1 <= max_leaves:
        size, node = heapq.heappop(queue)
        rows = members[node]
        if -size <= leaf_rows or len(rows) < branching:
            continue
        group = _kmeans(sample[rows], branching, rng)
        parts = [rows[group == j] for j in np.unique(group)]
        if len(parts) < 2:
            continue
        del members[node]
        first = len(centres)
        for i, part in enumerate(parts):
            total = sample[part].sum(axis=0)
            centres.append(total / max(np.sqrt(total @ total), 1e-300))
            children.append(np.zeros(0, np.int64))
            members[first + i] = part
            heapq.heappush(queue, (-len(part), first + i))
        children[node] = np.arange(first, first + len(parts))
        leaves += len(parts) - 1
    leaf = np.full(len(centres), -1, np.int64)
    ends = [i for i, c in enumerate(children) if not len(c)]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centres), children, leaf)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of two matrices' rows, pair by pair, each row summed in the same order."""
    return (q * x).sum(axis=1) / np.sqrt((q * q).sum(axis=1)) / np.sqrt((x * x).sum(axis=1))


def best(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """``(query row, row)`` pairs of the ``k`` best rows of each query, without its own id."""
    scores = unit(queries) @ unit(x).T
    scores[own[:, None] == ids[None, :]] = -np.inf
    bar = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -2.0)
    row, col = np.nonzero(scores >= np.maximum(bar - NEAR, -2.0)[:, None])
    value = exact_scores(queries[row], x[col])
    order = np.lexsort([ids[col], -value, row])
    row, col, value = row[order], col[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (ids[col[1:]] != ids[col[:-1]])
    row, col, value = row[fresh], col[fresh], value[fresh]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], col[keep], value[keep]


def _limited(df: DataFrame, share: float, key: str) -> DataFrame:
    """The rows whose hashed key falls in the first ``share`` of the range."""
    return df.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def calibrate(
    rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, query_rows: int = 256
) -> int:
    """The fewest visits with which a sample of queries reaches ``recall`` of its exact neighbours."""
    spark = rows.sparkSession
    sample = _limited(queries, query_rows / max(1, queries.count()), "id").limit(2 * query_rows).toArrow()
    if not len(sample):
        return tree.leaves
    asked, own = matrix(sample.column("vector")), sample.column("id").to_numpy()
    shared = spark.sparkContext.broadcast((tree, asked, own))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, asked, own = shared.value
        for batch in batches:
            x, ids = matrix(batch.column("vector")), batch.column("id").to_numpy()
            for a in range(0, len(x), BLOCK):
                row, col, value = best(asked, own, x[a : a + BLOCK], ids[a : a + BLOCK], k)
                leaf = tree.place(unit(x[a : a + BLOCK][col]))
                yield pa.record_batch({"q": row, "id": ids[a : a + BLOCK][col], "score": value, "leaf": leaf})

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = (
        rows.mapInArrow(nearest, "q long, id long, score double, leaf long")
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).toPandas()
    )
    paths = [np.argsort(v) for v in tree.visits(unit(asked))]
    needed = np.sort([paths[q][leaf] + 1 for q, leaf in zip(found["q"], found["leaf"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else tree.leaves


#: Rows of a block and queries of a chunk.
BLOCK = 2048


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.95,
    key: str = "vec_id", column: str = "embedding", sample_rows: int = 20_000, **tree_options,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows found, by cosine.

    ``queries`` has the columns of ``vectors``. The tree is fitted on about ``sample_rows`` rows.
    """
    spark = vectors.sparkSession
    named = [F.col(key).cast("long").alias("id"), F.col(column).alias("vector")]
    rows = usable(vectors, column).filter(F.col(key).isNotNull()).select(named)
    asked = usable(queries, column).filter(F.col(key).isNotNull()).select(named).groupBy("id").agg(F.min("vector").alias("vector"))
    sizes, wanted = ({r[0]: r[1] for r in x.groupBy(F.size("vector")).count().collect()} for x in (rows, asked))
    found = []
    for size in sorted(sizes.keys() & wanted.keys()):
        parts = (rows, asked) if len(sizes) == len(wanted) == 1 else [x.filter(F.size("vector") == size) for x in (rows, asked)]
        found.append(_search(*parts, sizes[size], wanted[size], k, recall, sample_rows, tree_options))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(
    rows: DataFrame, asked: DataFrame, n: int, n_asked: int, k: int, recall: float, sample_rows: int, tree_options: dict
) -> DataFrame:
    """:func:`search` over vectors of one length."""
    spark = rows.sparkSession
    chunks = max(1, -(-n_asked // BLOCK))
    sample = _limited(rows, sample_rows / n, "id").select("vector").limit(2 * sample_rows).toArrow()
    x = unit(matrix(sample.column("vector")))
    if not len(x):
        x = unit(matrix(rows.select("vector").limit(1).toArrow().column("vector")))
    tree = build_tree(x, **tree_options)
    visits = calibrate(rows, asked, tree, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(unit(matrix(batch.column("vector"))))
            yield pa.record_batch({**{c: batch.column(c) for c in ("id", "vector")}, "leaf": leaf})

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                paths = shared.value.visits(unit(matrix(part.column("vector"))), visits)
                row = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
                yield pa.record_batch({
                    "id": part.column("id").take(pa.array(row)), "vector": part.column("vector").take(pa.array(row)),
                    "leaf": np.concatenate([np.array(p, np.int64) for p in paths]),
                })

    kind = dict(rows.dtypes)["vector"]
    schema = f"id long, vector {kind}, leaf long"
    index = rows.mapInArrow(placed, schema)
    sizes = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    chunk = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(chunks)).cast("int").alias("chunk")
    index = index.join(F.broadcast(sizes), "leaf").select("id", "vector", "leaf", cut, every)
    walks = asked.mapInArrow(routed, schema).join(F.broadcast(sizes), "leaf").select(
        "id", "vector", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - F.lit(1))).alias("block"), chunk
    )

    def searched(at: pa.Table, walking: pa.Table) -> pa.Table:
        if not len(at) or not len(walking):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own, ids = walking.column("id").to_numpy(), at.column("id").to_numpy()
        row, col, value = best(matrix(walking.column("vector")), own, matrix(at.column("vector")), ids, k)
        return pa.table({"query_id": own[row], "vec_id": ids[col], "score": value})

    place = ("leaf", "block", "chunk")
    found = index.groupBy(*place).cogroup(walks.groupBy(*place)).applyInArrow(
        searched, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

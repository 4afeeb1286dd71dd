"""SimHash fingerprints, linked through BK-trees.

Fingerprints are bit majorities over the hashes of a text's word shingles. Equal fingerprints are
one entry. Two fingerprints within ``radius`` bits agree in one of ``radius + 1`` blocks of bits at
least, so entries meet by block; in each block's bucket a BK-tree holds them, children keyed by
the Hamming distance to the parent, and a query follows only edges within the radius. The trees of
a task are built and walked together in numpy. Trees are not broadcast, since all of them together
grow with the corpus; entries travel to the trees they can match instead, which loses no pair.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked
like any other; shorter texts than a shingle count as one shingle; repeated rows share their
entry; rows with a null id get a fingerprint and no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.buckets import by_unit, components, in_units, local_components
from manylabel.session import stage

#: Rows of a block of a hot bucket, and (query, node) visits held at a time.
BLOCK = 4096
VISITS = 1 << 17


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words, A-Z in lower case, repeats included."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[size - 1 :] if len(found) >= size else ends[-1:]
    parts = [joined[a:b] for a, b in zip(starts.tolist(), last.tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits (lowest first) set in over half of the hashes of a matrix ``(n, words)``."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, n, 255 * 64):
        part = hashes[a : a + 255 * 64]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            counts += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return 2 * counts > n


def fingerprint(text: bytes, size: int = 3) -> int:
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    return int(np.packbits(majority(hashes[:, None]), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``(key, print)`` of every row, the 64 bits as a long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint((t.as_py() or "").encode(), size) for t in batch.column("text")]
            yield pa.record_batch({"key": batch.column("key"), "print": np.array(prints, np.uint64).view(np.int64)})

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(work, f"key {dict(named.dtypes)['key']}, print long")


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two matrices of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)


class Forest:
    """BK-trees over ``prints``, one for each value of ``tree``, built level by level.

    The first item of a tree is its root; the items of a subtree at the same distance from its
    node go to one child, whose first item becomes the node.
    """

    def __init__(self, prints: np.ndarray, tree: np.ndarray):
        n = len(prints)
        self.prints = prints
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int32)
        order = np.argsort(tree, kind="stable")
        first = np.ones(n, bool)
        first[1:] = tree[order][1:] != tree[order][:-1]
        node = np.empty(n, np.int64)
        node[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        self.roots = dict(zip(tree[order[first]].tolist(), order[first].tolist()))
        rest = np.flatnonzero(node != np.arange(n))
        while len(rest):
            at = node[rest]
            d = distance(prints[rest], prints[at])
            place = np.lexsort([rest, d, at])
            at, d, moved = at[place], d[place], rest[place]
            first = np.ones(len(rest), bool)
            first[1:] = (at[1:] != at[:-1]) | (d[1:] != d[:-1])
            lead = moved[np.flatnonzero(first)[np.cumsum(first) - 1]]
            parent[lead[first]], edge[lead[first]] = at[first], d[first]
            node[moved] = lead
            rest = moved[~first]
        inner = np.flatnonzero(parent >= 0)
        self.child = inner[np.lexsort([edge[inner], parent[inner]])]
        self.code = parent[self.child] * 65536 + edge[self.child]

    def within(self, prints: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, node, distance)`` of all nodes within ``radius`` of each query."""
        todo = [(np.arange(len(prints)), root)]
        while todo:
            query, node = todo.pop()
            if len(query) > VISITS:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = distance(prints[query], self.prints[node])
            near = d <= radius
            if near.any():
                yield query[near], node[near], d[near]
            low = np.searchsorted(self.code, node * 65536 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.code, node * 65536 + d + radius, "right")
            width = high - low
            total = int(width.sum())
            if total:
                q = np.repeat(query, width)
                at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(total)
                todo.append((q, self.child[at]))


def _linked(keys: list[str], radius: int):
    unit = [*keys, "lo", "hi"]

    def link(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        ids = rows.column("id").to_numpy()
        prints = rows.column("print").to_numpy().view(np.uint64)[:, None]
        mine, lo, hi = (rows.column(c).to_numpy() for c in ("mine", "lo", "hi"))
        group = np.searchsorted(starts, np.arange(len(rows)), "right")
        inside = np.flatnonzero(mine == lo)
        asked = np.flatnonzero(mine == hi)
        forest = Forest(prints[inside], group[inside])
        root = np.array([forest.roots.get(g, -1) for g in group[asked].tolist()])
        asked, root = asked[root >= 0], root[root >= 0]
        left, right = [], []
        for q, node, _ in forest.within(prints[asked], root, radius):
            left.append(asked[q])
            right.append(inside[node])
            if sum(map(len, left)) > 4 * VISITS:
                label = local_components(len(rows), np.concatenate(left), np.concatenate(right))
                joined = np.flatnonzero(label != np.arange(len(rows)))
                left, right = [joined], [label[joined]]
        if not left:
            return None
        label = local_components(len(rows), np.concatenate(left), np.concatenate(right))
        joined = np.flatnonzero(label != np.arange(len(rows)))
        return pa.record_batch({"a": ids[joined], "b": ids[label[joined]]})

    return lambda batches: by_unit(batches, unit, link)


def near_components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``(key, print, component)``: the smallest key reachable over links of ``radius`` bits."""
    known = prints.filter(F.col("key").isNotNull())
    entries = stage(known.groupBy("print").agg(F.min("key").alias("id")), "simhash-entries")
    count = radius + 1
    cuts = [round(64 * i / count) for i in range(count + 1)]
    value = [
        F.shiftrightunsigned(F.shiftleft("print", 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]) for i in range(count)
    ]
    spread = entries.select("id", "print", F.posexplode(F.array(*value)).alias("part", "value"))
    keys = ["part", "value"]
    edges = in_units(spread, keys, "id", BLOCK).mapInArrow(_linked(keys, radius), "a long, b long")
    linked = components(edges, label="simhash-components")
    named = entries.join(linked, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    joined = prints.join(named, "print", "left")
    return joined.select("key", "print", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"))

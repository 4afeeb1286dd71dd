"""Near-duplicate documents: wide SimHash fingerprints, BK-trees in bands, and an exact check.

A fingerprint of several 64-bit words over a text's set of word shingles estimates the similarity
of two texts. Its bits are cut into bands; texts that agree in a band meet in a bucket, where a
BK-tree finds those within the radius. How many bits a band takes follows from the number of
texts, how many bands from the wanted recall at the threshold. A bucket gives a spanning forest
over the pairs found, nearest pairs first. Every link is checked against both texts' shingle sets;
only exact copies of a text count as one without a check.

A forest link that fails may have stood in the place of a true one. So buckets are looked through
again: rows within the radius of a row of another component meet in their buckets with their
texts, and there every pair of different components is checked, in the first band it agrees in.
Pairs never become rows; a bucket gives a spanning forest over the pairs that passed.

Similarity is the share of common shingles among all shingles of two texts. Defined results: null
and empty texts equal each other; a text shorter than a shingle is one shingle; a null id takes no
part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.buckets import by_unit, components, in_units, local_components
from manylabel.llm.simhash import Forest, majority, shingle_hashes
from manylabel.session import stage

BLOCK = 512
#: Bytes of a fingerprint that travel to the buckets, for the distance of two texts.
SKETCH = 48
#: Standard errors of the estimate beyond the threshold within which pairs are looked at.
MARGIN = 3.0


def differing(similarity: float) -> float:
    """Expected share of differing bits of two texts of a similarity, equal in length."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_sizes(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a band and number of bands for ``n`` texts."""
    bits = min(24, max(8, round(math.log2(max(n, 2))) - 4))
    hit = (1 - differing(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def wide_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words of bit majorities over distinct shingle hashes."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    x = np.unique(hashes)[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.packbits(majority(x ^ (x >> np.uint64(31))), bitorder="little").view(np.uint64)


def _printed(shingle: int, bits: int, bands: int):
    words = -(-bits * bands // 64)
    scale = 1 << np.arange(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.slice(a, 500) for b in batches for a in range(0, len(b), 500)):
            prints = np.array(
                [wide_print(shingle_hashes((t.as_py() or "").encode(), shingle), words) for t in rows.column("text")], np.uint64
            ).reshape(-1, words)
            flat = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : bits * bands]
            values = (flat.reshape(len(prints), bands, bits) * scale).sum(axis=2).astype(np.int32)
            yield pa.record_batch({
                "id": rows.column("id"), "copy": rows.column("copy"), "print": pa.array([p.tobytes() for p in prints], pa.binary()),
                "bands": pa.ListArray.from_arrays(np.arange(0, values.size + 1, bands, dtype=np.int32), values.ravel()),
            })

    return work


def spanning(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Pairs of a shortest spanning forest of ``n`` rows, by Boruvka's rounds."""
    label, chosen = np.arange(n), []
    weight = d.astype(np.int64) << 40 | np.arange(len(a))
    left = np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            break
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, x, weight[left])
        np.minimum.at(best, y, weight[left])
        pick = np.unique(best[best < np.iinfo(np.int64).max] & ((1 << 40) - 1))
        chosen.append(pick)
        step = local_components(n, label[a[pick]], label[b[pick]])
        label = step[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


UNIT = ["part", "value", "lo", "hi"]


def _near(rows: pa.RecordBatch, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some whole units' rows, and the pairs among them of different components within the radius."""
    words = np.frombuffer(b"".join(rows.column("print").to_pylist()), np.uint64).reshape(len(rows), -1)
    mine, lo, hi, component = (rows.column(c).to_numpy() for c in ("mine", "lo", "hi", "component"))
    group = np.searchsorted(starts, np.arange(len(rows)), "right")
    cuts = [0]
    for i in range(1, len(starts)):  # whole units, about 1,024 rows at a time
        if starts[i] - starts[cuts[-1]] >= 2 * BLOCK or i == len(starts) - 1:
            cuts.append(i)
    for c, e in zip(cuts[:-1], cuts[1:]):
        part = np.arange(starts[c], starts[e])
        inside, asked = part[mine[part] == lo[part]], part[mine[part] == hi[part]]
        forest = Forest(words[inside], group[inside])
        root = np.array([forest.roots.get(g, -1) for g in group[asked].tolist()], np.int64)
        asked, root = asked[root >= 0], root[root >= 0]
        found = []
        for q, node, d in forest.within(words[asked], root, radius):
            a, b = asked[q], inside[node]
            keep = (component[a] != component[b]) & ((a < b) | (mine[a] != mine[b]))
            found.append((a[keep] - part[0], b[keep] - part[0], d[keep]))
        if any(len(x[0]) for x in found):
            yield part, *(np.concatenate(x) for x in zip(*found))


def _linked(radius: int):
    def link(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, out = rows.column("id").to_numpy(), []
        for part, a, b, d in _near(rows, starts, radius):
            pick = spanning(len(part), a, b, d)
            out.append((ids[part[a[pick]]], ids[part[b[pick]]]))
        if not out:
            return None
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.record_batch({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return lambda batches: by_unit(batches, UNIT, link)


def _apart(radius: int):
    """The units' rows within the radius of a row of another component."""

    def apart(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        open_ = [part[np.unique(np.concatenate([a, b]))] for part, a, b, _ in _near(rows, starts, radius)]
        return rows.select([*UNIT, "mine", "id"]).take(pa.array(np.concatenate(open_))) if open_ else None

    return lambda batches: by_unit(batches, UNIT, apart)


def alike(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of each pair ``(a, b)``, sorted by ``a``, are at least ``similarity`` alike."""
    size = np.array([len(x) for x in sets], np.int64)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(place) + 1, bool)
    common = np.zeros(len(a), np.int64)
    bounds = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
    for c, e in zip(bounds[:-1], bounds[1:]):
        own = place[at[a[c]] : at[a[c] + 1]]
        mark[own] = True
        common[c:e] = [np.count_nonzero(mark[place[at[x] : at[x + 1]]]) for x in b[c:e]]
        mark[own] = False
    return common >= similarity * (size[a] + size[b] - common)


def _confirmed(radius: int, shingle: int, similarity: float):
    """A spanning forest over the units' pairs of different components that are alike."""

    def confirm(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, part_no, out = rows.column("id").to_numpy(), rows.column("part").to_numpy(), []
        bands = rows.column("bands").flatten().to_numpy().reshape(len(rows), -1)
        for part, a, b, d in _near(rows, starts, radius):
            here = part_no[part[a]]
            first = np.concatenate([
                (bands[part[a[i : i + 65536]]] == bands[part[b[i : i + 65536]]]).argmax(axis=1) for i in range(0, len(a), 65536)
            ]) == here
            order = np.flatnonzero(first)[np.argsort(a[first], kind="stable")]
            a, b, d = a[order], b[order], d[order]
            used = np.zeros(len(part), bool)
            used[a] = used[b] = True
            none = np.zeros(0, np.uint64)
            sets = [
                np.unique(shingle_hashes((t.as_py() or "").encode(), shingle)) if u else none
                for u, t in zip(used, rows.column("text").slice(part[0], len(part)))
            ]
            keep = alike(sets, a, b, similarity)
            a, b, d = a[keep], b[keep], d[keep]
            pick = spanning(len(part), a, b, d)
            out.append((ids[part[a[pick]]], ids[part[b[pick]]]))
        if not out:
            return None
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.record_batch({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return lambda batches: by_unit(batches, UNIT, confirm)


def _checked(shingle: int, similarity: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.unique(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common >= similarity * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return check


def near_documents(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.99, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(key, component)``: the smallest id reachable over texts at least ``similarity`` alike."""
    named = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    bits, bands = band_sizes(named.count(), similarity, recall)
    size = min(8 * SKETCH, 64 * -(-bits * bands // 64))
    edge = differing(similarity)
    slack = MARGIN * math.sqrt(edge * (1 - edge) / size)
    prints = stage(
        named.withColumn("copy", F.unhex(F.md5("text"))).mapInArrow(
            _printed(shingle, bits, bands), "id long, copy binary, print binary, bands array<int>"
        ), "near-prints",
    )
    entries = stage(
        prints.groupBy("copy").agg(F.min("id").alias("id"), F.first("print").alias("print"), F.first("bands").alias("bands")),
        "near-entries",
    )
    texts = named.groupBy("id").agg(F.collect_set("text").alias("texts")).select("id", F.explode("texts").alias("text"))
    radius = math.floor(size * (edge + slack))

    def units(rows: DataFrame) -> DataFrame:
        sketch = F.substring("print", 1, SKETCH).alias("print")
        spread = rows.select("id", "component", sketch, F.posexplode("bands").alias("part", "value"))
        return in_units(spread, ["part", "value"], "id", BLOCK)

    found = stage(
        units(entries.withColumn("component", F.col("id"))).mapInArrow(_linked(radius), "a long, b long").distinct(), "near-links"
    )
    pairs = found.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b"
    ).select("a", "b", "x", "y")
    near = stage(pairs.mapInArrow(_checked(shingle, similarity), "a long, b long"), "near-passed")
    joined = stage(
        entries.join(components(near, label="near-components"), "id", "left").select(
            "id", "print", "bands", F.coalesce("component", "id").alias("component")
        ), "near-joined",
    )
    apart = stage(
        units(joined).mapInArrow(_apart(radius), "part int, value int, lo int, hi int, mine int, id long"), "near-apart"
    )
    whole = apart.join(joined.withColumn("print", F.substring("print", 1, SKETCH)), "id").join(texts, "id")
    missed = whole.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(
        _confirmed(radius, shingle, similarity), "a long, b long"
    )
    roots = components(near.union(missed), label="near-components")
    named_entries = entries.select("copy", "id").join(roots, "id", "left").select(
        "copy", F.coalesce("component", "id").alias("component")
    )
    return prints.select(F.col("id").alias("key"), "copy").join(named_entries, "copy").select("key", "component")

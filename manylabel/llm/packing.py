"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

A bin holds at most ``per_source`` documents of one source and one document of a duplicate
cluster. Open bins are ordered by what is left in them; each carries bitmaps of its sources and
clusters. A document goes, largest first, to the tightest bin that is compatible: the search
starts at the successor of its size and goes on through wider bins until one fits.

Documents longer than a bin are cut: full pieces fill bins of their own, the rest is packed. The
packing runs in groups of about ``group_rows`` documents, drawn by a hash of a staged row number,
so every group has the table's mix, and bins of different groups never conflict. Nothing but
counts reaches the driver.

Defined results: a document without words (null or empty text) takes part with no bin
(``bin_id`` null, zero words); a null source or cluster conflicts with nothing; repeated rows are
packed as documents of their own; ties in size go by row number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.batches import text_slices, words
from manylabel.session import stage


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int = 1) -> tuple[list[int], list[int]]:
    """Bin and offset in it of each item; items are placed from the largest down."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    left: list[tuple[int, int]] = []
    seen: list[list[int]] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        s = 0 if sources[i] is None else 1 << source_bit.setdefault(sources[i], len(source_bit))
        c = 0 if clusters[i] is None else 1 << cluster_bit.setdefault(clusters[i], len(cluster_bit))
        at = bisect_left(left, (size, -1))
        while at < len(left) and (seen[left[at][1]][per_source] & s or seen[left[at][1]][0] & c):
            at += 1
        if at < len(left):
            room, b = left.pop(at)
        else:
            room, b = capacity, len(seen)
            seen.append([0] * (per_source + 1))
        maps = seen[b]
        maps[0] |= c
        for level in range(per_source, 0, -1):
            if level == 1 or maps[level - 1] & s:
                maps[level] |= s
                break
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            insort(left, (room - size, b))
    return bins, offsets


def _measured(keep: list[str], text: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text):
                _, _, at = words(data, offsets)
                yield pa.record_batch({k: rows.column(k) for k in keep} | {"n_words": np.diff(at)})

    return measure


def _packed(capacity: int, per_source: int):
    def pack(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        n = rows.column("n_words").to_numpy()
        rest = n % capacity
        part = np.flatnonzero(rest)
        bins, offsets = best_fit(
            rest[part].tolist(), rows.column("source").take(part).to_pylist(),
            rows.column("cluster").take(part).to_pylist(), capacity, per_source,
        )
        own = np.repeat(np.arange(len(n)), n // capacity)
        piece = np.arange(len(own)) - np.searchsorted(own, own)
        used = (max(bins) + 1) if bins else 0
        none = np.flatnonzero(n == 0)
        take = np.concatenate([part, own, none])
        group = key[0].as_py()
        number = np.concatenate([np.array(bins, np.int64), used + np.arange(len(own)), np.zeros(len(none), np.int64)])
        return pa.table({
            "doc_id": rows.column("doc_id").take(take),
            "piece": pa.array(np.concatenate([n[part] // capacity, piece, np.zeros(len(none))]).astype(np.int32)),
            "first_word": pa.array(np.concatenate([n[part] - rest[part], piece * capacity, np.zeros(len(none))]).astype(np.int64)),
            "n_words": pa.array(np.concatenate([rest[part], np.full(len(own), capacity), np.zeros(len(none))]).astype(np.int64)),
            "bin_id": pa.array([f"{group}-{b}" for b in number.tolist()], pa.string(), mask=np.arange(len(take)) >= len(part) + len(own)),
            "bin_offset": pa.array(np.concatenate([offsets, np.zeros(len(own) + len(none))]).astype(np.int64)),
        })

    return pack


def pack_documents(
    docs: DataFrame, cluster: F.Column, capacity: int = 2048, per_source: int = 2, group_rows: int = 2048,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``(doc_id, piece, first_word, n_words, bin_id, bin_offset)``, one row for each piece."""
    named = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), cluster.alias("cluster"), F.col(text).alias("text"))
    keep = ["doc_id", "source", "cluster"]
    fields = ", ".join(f"{k} {t}" for k, t in named.select(keep).dtypes)
    items = stage(
        named.mapInArrow(_measured(keep, "text"), f"{fields}, n_words long")
        .withColumn("row", F.monotonically_increasing_id()), "packing",
    )
    groups = max(1, -(-items.count() // group_rows))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    return items.groupBy(group).applyInArrow(
        _packed(capacity, per_source),
        f"doc_id {dict(items.dtypes)['doc_id']}, piece int, first_word long, n_words long, bin_id string, bin_offset long",
    )

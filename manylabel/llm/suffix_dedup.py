"""Removal of byte strings that start in an earlier document, by suffix arrays.

Each shard of texts gets a suffix array by Larsson-Sadakane refinement: suffixes are sorted by
their first bytes, and groups still equal are refined by the ranks of the suffixes ``h`` further
on, with ``h`` doubling. Kasai's rule gives the common prefixes of neighbours: only where the bytes
before two neighbours differ is a prefix compared anew, elsewhere it is one less than at the byte
before. Runs of neighbours with ``length`` common bytes are the shard's repeated strings.

Across shards, each string of ``length`` bytes belongs to the smallest hash of its short strings
(its anchor), so equal strings have equal anchors wherever they stand, and a text is a sequence
of runs of strings with one anchor. Shards exchange sorted lists that merge by search in hash
order: first anchors; then, for shared anchors, a hash of the whole run; then single strings, for
runs that no smaller document has whole but that share their anchor with a different run.

Defined results: null and empty texts have no bytes; a null id counts as the largest; rows of one
id never remove each other's bytes; repeated rows with different ids keep the smallest id's copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.batches import utf8
from manylabel.llm.exchange import SENT, Shards, merged, prefix_hash, range_bounds, range_hash, sent
from manylabel.session import stage

#: Bytes of the short string whose hash anchors a longer one.
ANCHOR = 24
SHARD_BYTES = 1_000_000
LAST = np.iinfo(np.int64).max
BYTE_VALUES = np.random.default_rng(77).integers(1, 1 << 63, 256).astype(np.uint64)
SHORT_VALUES = (BYTE_VALUES >> np.uint64(20)).astype(np.uint32)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes of ``codes`` (small whole numbers) in order."""
    n = len(codes)
    if n < 2:
        return np.arange(n)
    bits, kind = n.bit_length(), np.int32 if n < 1 << 29 else np.int64
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    dense = np.cumsum(used).astype(np.uint64)  # 0 stands for the places behind the end
    base = int(dense[-1]) + 1
    length = max(1, int((64 - bits) / np.log2(base)))
    wide = np.zeros(n + length, np.uint64)
    wide[:n] = dense[codes]
    packed = wide[:n].copy()
    for j in range(1, length):
        packed *= np.uint64(base)
        packed += wide[j : n + j]
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    packed <<= shift
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    suffixes = (packed & mask).astype(kind)
    packed >>= shift
    fresh = np.ones(n, bool)
    fresh[1:] = packed[1:] != packed[:-1]
    rank = np.zeros(n + 1, kind)
    first = np.maximum.accumulate(np.where(fresh, np.arange(1, n + 1, dtype=kind), 0))
    rank[suffixes] = first
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(kind)
    first = first[open_]
    h = length
    while len(open_):
        at = suffixes[open_]
        second = rank[np.minimum(at + kind(h), n)]
        if 3 * bits <= 64:
            packed = first.astype(np.uint64)
            for part in (second, at):
                packed <<= shift
                packed |= part.astype(np.uint64)
            packed.sort()
            at = (packed & mask).astype(kind)
            packed >>= shift
            changed = packed[1:] != packed[:-1]
        else:
            order = np.lexsort([second, first])
            at, first, second = at[order], first[order], second[order]
            changed = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        suffixes[open_] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = changed
        first = np.maximum.accumulate(np.where(fresh, open_ + kind(1), 0))
        rank[at] = first
        stay = ~(fresh & np.append(fresh[1:], True))
        open_, first = open_[stay], first[stay]
        h *= 2
    return suffixes


def common_prefixes(codes: np.ndarray, suffixes: np.ndarray, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """By position: length of the prefix shared with the suffix before it in order."""
    n, kind = len(codes), np.int32 if len(codes) < 1 << 30 else np.int64
    suffixes = suffixes.astype(kind, copy=False)
    before = np.full(n, -1, kind)
    before[suffixes[1:]] = suffixes[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = codes
    words = np.ndarray((n + 1,), np.uint64, padded, 0, (1,))
    # the byte before a neighbour at 0 reads as the 0 behind the end, and is compared anew
    anew = np.ones(n, bool)
    anew[1:] = (padded[before[1:] - 1] != padded[: n - 1]) | (before[1:] == 0)
    anew &= before >= 0
    at = np.flatnonzero(anew).astype(kind)
    other = before[at]
    gap = words[at] ^ words[other]
    shared = _low_bytes(gap)
    todo = np.flatnonzero(gap == 0)
    room = n - np.maximum(at, other)
    for _ in range(7):
        a, b = at[todo] + shared[todo], other[todo] + shared[todo]
        gap = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        shared[todo] += _low_bytes(gap)
        todo = todo[(gap == 0) & (shared[todo] < room[todo])]
        if not len(todo):
            break
    shared = np.minimum(shared, room)
    if len(todo):
        hashed = hashed or prefix_hash(BYTE_VALUES[codes], 0x9E3779B97F4A7C15)
        low, high = shared[todo], room[todo]
        while (low < high).any():
            half = (low + high + 1) // 2
            same = range_hash(hashed, at[todo], at[todo] + half) == range_hash(hashed, other[todo], other[todo] + half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        shared[todo] = low
    start = np.full(n, -n, kind)
    start[at] = at + shared
    start[before < 0] = 0
    np.maximum.accumulate(start, out=start)
    start -= np.arange(n, dtype=kind)
    return np.maximum(start, 0, out=start)


def _low_bytes(gap: np.ndarray) -> np.ndarray:
    """Number of low zero bytes of each word."""
    return (np.bitwise_count((gap & -gap) - np.uint64(1)) >> 3).astype(np.int32)


class Texts:
    """Bytes of a shard's texts, the strings of ``length`` bytes in them and their documents."""

    def __init__(self, rows: pa.StructArray, text: str, key: str, length: int):
        self.length = length
        self.data, self.offsets = utf8(rows.field(text))
        ids = rows.field(key)
        self.ids = ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        sizes = np.maximum(np.diff(self.offsets) - length + 1, 0)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.repeat(self.offsets[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else sizes
        self.strings = first + np.arange(int(sizes.sum()))

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        return prefix_hash(BYTE_VALUES[self.data], 0x9E3779B97F4A7C15)

    def repeated(self) -> np.ndarray:
        """For each string: whether a smaller document of the shard has it too."""
        n = len(self.data)
        if not len(self.strings):
            return np.zeros(0, bool)
        used = np.zeros(256, bool)
        used[self.data] = True
        dense = np.cumsum(used).astype(np.uint8)  # UTF-8 uses 243 byte values at most; 0 ends a text
        lengths = np.diff(self.offsets)
        codes = np.zeros(n + len(lengths), np.uint8)
        inside = np.ones(len(codes), bool)
        inside[self.offsets[1:] + np.arange(len(lengths))] = False  # where a text ends
        codes[inside] = dense[self.data]
        suffixes = suffix_array(codes)
        same = (common_prefixes(codes, suffixes) >= self.length)[suffixes]
        same[0] = False
        member = same.copy()
        member[:-1] |= same[1:]
        member = np.flatnonzero(member)
        gone = np.zeros(len(codes), bool)
        if len(member):
            starts = np.flatnonzero(~same[member])
            at = suffixes[member]
            document = self.ids[np.searchsorted(self.offsets[1:] + np.arange(len(lengths)), at)]
            least = np.minimum.reduceat(document, starts)
            gone[at] = document > np.repeat(least, np.diff(np.append(starts, len(member))))
        return gone[self.strings + self.owner]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of strings in each run of one anchor, and the anchor's place in the run."""
        n, span = len(self.data), self.length - ANCHOR + 1
        if not len(self.strings):
            return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        parts, factor, width = {1: SHORT_VALUES[self.data]}, 0x9E3779B1, 1
        while 2 * width <= ANCHOR:
            h = parts[width]
            parts[2 * width] = h[:-width] * np.uint32(factor) + h[width:]
            factor, width = factor * factor & 0xFFFFFFFF, 2 * width
        h, size = parts[width], width
        for w in sorted(parts, reverse=True):
            if size + w <= ANCHOR and w < width:
                tail = parts[w][size:]
                h = h[: len(tail)] * np.uint32(pow(0x9E3779B1, w, 1 << 32)) + tail
                size += w
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        best = (h ^ (h >> np.uint32(13))).astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if span > width:
            best = np.minimum(best[: width - span], best[span - width :])
        anchor = (best[self.strings] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        starts = np.flatnonzero(fresh)
        return np.diff(np.append(starts, len(anchor))).astype(np.uint8), (anchor[starts] - self.strings[starts]).astype(np.uint8)


class Runs:
    """The runs of a shard again, from what the first pass kept of it."""

    def __init__(self, texts: Texts, kept: dict):
        self.texts = texts
        self.sizes = np.frombuffer(kept["low"], np.uint8).astype(np.int64)
        place = np.frombuffer(kept["high"], np.uint8)
        pairs = np.frombuffer(kept["extra"], np.int64).reshape(-1, 2)
        self.gone = np.zeros(len(texts.strings) + 1, np.int64)
        np.add.at(self.gone, pairs[:, 0], 1)
        np.add.at(self.gone, pairs[:, 1], -1)
        self.gone = np.cumsum(self.gone)[:-1] > 0
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.total = texts.hashed()
        start = texts.strings[self.first] if len(self.first) else self.first
        live = np.concatenate([[0], np.cumsum(~self.gone)])
        self.live = np.flatnonzero(live[self.first + self.sizes] > live[self.first])
        anchor = start[self.live] + place[self.live]
        self.keys = range_hash(self.total, anchor, anchor + ANCHOR)
        self.start = start[self.live]
        end = self.start + self.sizes[self.live] - 1 + texts.length
        self.context = range_hash(self.total, self.start, end) ^ (place[self.live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.document = texts.ids[texts.owner[self.first[self.live]]] if len(self.live) else self.live

    def shared(self, answers: list[bytes], parts: int) -> np.ndarray:
        """Live runs whose anchor another shard has too, by anchor, context and document."""
        found, back = np.unique(self.keys, return_inverse=True)
        hot = _read(answers, found, parts, np.uint8).astype(bool)[back]
        at = np.flatnonzero(hot)
        return at[np.lexsort([self.document[at], self.context[at], self.keys[at]])]

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First run of each (anchor, context) in ``at``, and each run's entry."""
        fresh = np.ones(len(at), bool)
        fresh[1:] = (self.keys[at[1:]] != self.keys[at[:-1]]) | (self.context[at[1:]] != self.context[at[:-1]])
        return at[fresh], np.cumsum(fresh) - 1

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings of the given live runs that are not gone yet, and the run of each."""
        sizes = self.sizes[self.live[runs]]
        first = self.first[self.live[runs]]
        string = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        owner = np.repeat(runs, sizes)
        stay = ~self.gone[string]
        return string[stay], owner[stay]


def _read(answers: list[bytes], keys: np.ndarray, parts: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(answers), kind) if answers else np.zeros(len(keys), kind)


def _elsewhere(lists: list[dict]) -> list[bytes]:
    """For each list, which of its hashes another list has too."""
    low = [np.frombuffer(x["low"], np.uint32) for x in lists]
    values = np.concatenate(low).astype(np.uint64)
    packed = np.sort(values << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
    order = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = (packed[1:] >> np.uint64(32)) == (packed[:-1] >> np.uint64(32))
    answer = np.zeros(len(values), np.uint8)
    answer[order[1:]] |= same
    answer[order[:-1]] |= same
    return [x.tobytes() for x in np.split(answer, np.cumsum([len(x) for x in low])[:-1])]


def _documents(lists: list[dict]) -> np.ndarray:
    """The document of each entry: a list ends in numbers into the ids that it starts with."""
    out = []
    for x in lists:
        n = len(x["low"]) // 8
        ids = np.frombuffer(x["extra"], np.int64, (len(x["extra"]) - 4 * n) // 8)
        out.append(ids[np.frombuffer(x["extra"], np.int32, n, 8 * len(ids))])
    return np.concatenate(out)


def _earlier(lists: list[dict], several: bool) -> list[bytes]:
    """1 where a smaller document has the same (anchor, hash), 2 where only the anchor has more."""
    low = [np.frombuffer(x["low"], np.uint64) for x in lists]
    values = np.concatenate(low)
    anchors = np.concatenate([np.frombuffer(x["high"], np.uint32) for x in lists])
    documents = _documents(lists)
    order = np.lexsort([documents, values, anchors])
    fresh = np.ones(len(order), bool)
    a, v, d = anchors[order], values[order], documents[order]
    fresh[1:] = (a[1:] != a[:-1]) | (v[1:] != v[:-1])
    least = d[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else d
    code = (d > least).astype(np.uint8)
    if several:
        group = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])])
        kinds = np.bincount(group, fresh)
        code[(code == 0) & (kinds[group] > 1)] = 2
    answer = np.empty(len(order), np.uint8)
    answer[order] = code
    return [x.tobytes() for x in np.split(answer, np.cumsum([len(x) for x in low])[:-1])]


def _sent_entries(shard: int, level: int, parts: int, keys: np.ndarray, values: np.ndarray, documents: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Like ``sent``, for entries with a document each; ``keys`` are sorted but not distinct."""
    bounds = range_bounds(keys, parts)
    for part in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[part], bounds[part + 1]
        ids, number = np.unique(documents[a:b], return_inverse=True)
        yield pa.record_batch({
            "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int64()), "level": pa.array([level], pa.int32()),
            "low": pa.array([values[a:b].tobytes()], pa.binary()),
            "high": pa.array([keys[a:b].astype(np.uint32).tobytes()], pa.binary()),
            "extra": pa.array([ids.tobytes() + number.astype(np.int32).tobytes()], pa.binary()),
        })


def _kept(answers: dict) -> dict:
    low, high, extra = answers[-1]
    return {"low": low, "high": high, "extra": extra}


def remove_repeated_strings(
    docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    with_text: bool = False, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    ``with_text`` adds ``kept_text``; bytes of a character that lost others are left out there.
    """
    if not ANCHOR <= length <= ANCHOR + 200:
        raise ValueError("length must be from 24 to 224")
    shards = Shards(docs.select(*dict.fromkeys([*keep, key, text])), text, shard_bytes, "suffixes")
    parts = shards.parts(shards.n_bytes / 12)
    fine = shards.parts(shards.n_bytes / 6)

    def first(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        texts = Texts(rows, text, key, length)
        gone = texts.repeated()
        sizes, place = texts.runs()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = {"low": sizes.tobytes(), "high": place.tobytes(), "extra": edge.astype(np.int64).tobytes()}
        yield pa.record_batch({
            "part": pa.array([0], pa.int32()), "shard": pa.array([shard], pa.int64()), "level": pa.array([-1], pa.int32()),
            **{k: pa.array([v], pa.binary()) for k, v in kept.items()},
        })
        found = np.unique(Runs(texts, kept).keys)
        yield from sent(shard, 0, parts, found, (found & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    start = stage(shards.run(first, SENT), "suffix-lists")
    held = start.filter("level = -1").select(
        "shard", F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col(c).alias("answer")) for i, c in enumerate(("low", "high", "extra"))))).alias("x")
    ).select("x.part", "shard", F.lit(-1).alias("level"), "x.answer")
    replies = held.unionByName(merged(start.filter("level = 0"), _elsewhere))

    def second(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        runs = Runs(Texts(rows, text, key, length), _kept(answers))
        entry, _ = runs.entries(runs.shared(answers.get(0, []), parts))
        yield from _sent_entries(shard, 1, fine, runs.keys[entry], runs.context[entry], runs.document[entry])

    replies = replies.unionByName(merged(shards.run(second, SENT, replies), lambda x: _earlier(x, True)))

    def judged(runs: Runs, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """Runs that a smaller document has whole, and runs whose strings must be looked up.

        A document may have a run several times; all of them are looked up.
        """
        at = runs.shared(answers.get(0, []), parts)
        entry, number = runs.entries(at)
        code = _read(answers.get(1, []), entry, fine, np.uint8)[number]
        own = runs.document[at] == runs.document[entry][number]
        return at[code == 1], at[(code == 2) & own]

    def third(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        runs = Runs(Texts(rows, text, key, length), _kept(answers))
        string, run = runs.windows(judged(runs, answers)[1])
        begin = runs.texts.strings[string]
        yield from _sent_entries(shard, 2, fine, runs.keys[run], range_hash(runs.total, begin, begin + length), runs.document[run])

    replies = replies.unionByName(merged(shards.run(third, SENT, replies), lambda x: _earlier(x, False)))

    def last(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        texts = Texts(rows, text, key, length)
        runs = Runs(texts, _kept(answers))
        whole, doubtful = judged(runs, answers)
        gone = runs.gone.copy()
        string, _ = runs.windows(whole)
        gone[string] = True
        string, _ = runs.windows(doubtful)
        gone[string[_read(answers.get(2, []), string, fine, np.uint8) == 1]] = True
        cover = np.zeros(len(texts.data) + 1, np.int64)
        begin = texts.strings[gone]
        cover[begin] += 1
        np.subtract.at(cover, begin + length, 1)
        cover = np.cumsum(cover)[:-1] > 0
        rising = cover & ~np.append(False, cover[:-1])
        inner = texts.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(cover))]
        rising[inner] = cover[inner]
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[texts.offsets])
        stay = texts.data[~cover]
        ends = np.concatenate([[0], np.cumsum(~cover)])[texts.offsets]
        kept = [stay[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        columns = {k: rows.field(k) for k in keep} | {
            "n_bytes": np.diff(texts.offsets), "n_removed": count(cover), "n_spans": count(rising),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        }
        if with_text:
            missing = rows.field(text).is_null().to_numpy(zero_copy_only=False)
            columns["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string(), mask=missing)
        yield pa.record_batch(columns)

    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    extra = ", kept_text string" if with_text else ""
    return shards.run(last, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}", replies)

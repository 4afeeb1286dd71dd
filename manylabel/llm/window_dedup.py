"""Removal of repeated word windows by level-wise doubling.

Windows of a short length are looked up first. Only a window whose two halves (they may overlap by
a word) are repeated is looked up at twice the length, and so on up to the wanted length: a window
cannot be repeated unless its parts are. Shorter levels exchange 32 bits of a hash in its range,
so a clash only lets a window through to the next level; the last level compares 96 bits.

Words are runs of bytes other than blanks (0x20, 0x09 to 0x0D). Every word covered by a repeated
window goes, first occurrences included. Defined results: null and empty texts have no words;
texts shorter than a window keep all; repeated rows repeat their windows, so both lose them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from manylabel.llm.batches import pieces, utf8, words
from manylabel.llm.exchange import SENT, Shards, merged, prefix_hash, range_bounds, range_hash, sent

BYTE_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256).astype(np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def levels(window: int, shortest: int = 9) -> list[int]:
    """Window lengths from about ``shortest`` up, each at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class Windows:
    """Hashes of the word windows of a shard's texts."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        self.starts, self.ends, self.at = words(self.data, self.offsets)
        coded = prefix_hash(BYTE_VALUES[self.data], BASES[0])
        self.words = range_hash(coded, self.starts, self.ends)
        self.last = np.repeat(self.at[1:], np.diff(self.at))
        self.sums = [prefix_hash(self.words, BASES[0])]

    def places(self, length: int, before: np.ndarray | None, shorter: int) -> np.ndarray:
        """First words of the windows to look up at ``length``."""
        at = np.arange(len(self.words))
        fits = at + length <= self.last
        if before is not None:
            fits &= before
            at = at[fits]
            return at[before[at + length - shorter]]
        return at[fits]

    def hashes(self, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        if second and len(self.sums) == 1:
            self.sums.append(prefix_hash(self.words ^ (self.words >> np.uint64(7)), BASES[1]))
        return range_hash(self.sums[second], at, at + length)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a row of each, whether each is repeated, and each row's key."""
    found, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return found, first, count > 1, back


def _repeated(lists: list[dict]) -> list[bytes]:
    """For each list, bits of the hashes that another list has too or that its own flag marks."""
    low = [np.frombuffer(x["low"], np.uint32 if x["high"] is None else np.uint64) for x in lists]
    sizes = [len(x) for x in low]
    values = np.concatenate(low)
    flags = np.concatenate([np.frombuffer(x["extra"], np.uint8) for x in lists])
    if lists[0]["high"] is None:
        packed = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))
        order = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = (packed[1:] >> np.uint64(32)) == (packed[:-1] >> np.uint64(32))
    else:
        other = np.concatenate([np.frombuffer(x["high"], np.uint32) for x in lists])
        order = np.lexsort([other, values])
        same = (values[order[1:]] == values[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
    group = np.concatenate([[0], np.cumsum(~same)])
    hot = np.bincount(group, minlength=1) > 1
    hot[group[flags[order] > 0]] = True
    answer = np.empty(len(values), bool)
    answer[order] = hot[group]
    ends = np.cumsum(sizes)
    return [np.packbits(answer[e - n : e]).tobytes() for e, n in zip(ends, sizes)]


def _read(answers: list[bytes], keys: np.ndarray, parts: int) -> np.ndarray:
    """The answers to sorted ``keys``, in their order."""
    sizes = np.diff(range_bounds(keys, parts))
    out = [np.unpackbits(np.frombuffer(a, np.uint8), count=n) for a, n in zip(answers, sizes[sizes > 0].tolist())]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _walk(windows: Windows, lengths: list[int], parts: list[int], answers: dict[int, list[bytes]]):
    """Repeated windows by first word at each level answered; then the next level's places."""
    before, shorter = None, 0
    for level, length in enumerate(lengths):
        at = windows.places(length, before, shorter)
        if level not in answers:
            return before, at
        found, _, _, back = _unique(windows.hashes(at, length))
        before = np.zeros(len(windows.words), bool)
        before[at] = _read(answers[level], found, parts[level])[back]
        shorter = length
    return before, None


def remove_repeated_windows(docs: DataFrame, window: int = 35, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_removed`` and ``kept_sha256`` of the words that stay.

    ``with_text`` adds ``kept_text``, the words that stay joined by blanks.
    """
    shards = Shards(docs.select(*dict.fromkeys([*keep, text])), text, label="windows")
    lengths = levels(window)
    parts = [shards.parts(shards.n_bytes / 6)] * len(lengths)
    replies = None

    for level, length in enumerate(lengths):
        final = level == len(lengths) - 1

        def ask(shard: int, rows: pa.StructArray, answers: dict, level=level, length=length, final=final) -> Iterator[pa.RecordBatch]:
            windows = Windows(rows.field(text))
            if len(answers) < level:
                return
            _, at = _walk(windows, lengths[: level + 1], parts, answers)
            keys = windows.hashes(at, length)
            found, first, again, _ = _unique(keys)
            high = (windows.hashes(at[first], length, second=True) >> np.uint64(32)).astype(np.uint32) if final else None
            low = found if final else (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield from sent(shard, level, parts[level], found, low, high, again.astype(np.uint8))

        answer = merged(shards.run(ask, SENT, replies), _repeated)
        replies = answer if replies is None else replies.unionByName(answer)

    def removed(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        windows = Windows(rows.field(text))
        n = len(windows.words)
        hot = None
        if len(answers) == len(lengths):
            hot, _ = _walk(windows, lengths, parts, answers)
        gone = np.zeros(n + 1, np.int64)
        if hot is not None:
            at = np.flatnonzero(hot)
            gone[at] += 1
            np.subtract.at(gone, at + window, 1)
        gone = np.cumsum(gone)[:n] > 0
        counts = np.concatenate([[0], np.cumsum(gone)])[windows.at]
        stay = np.flatnonzero(~gone)
        sizes = windows.ends[stay] - windows.starts[stay] + 1
        padded = np.append(windows.data, np.uint8(32))
        out = pieces(padded, windows.starts[stay], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out[ends[1:] - 1] = 32
        place = ends[np.searchsorted(stay, windows.at)]
        kept = [out[a : max(a, b - 1)].tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
        columns = {k: rows.field(k) for k in keep} | {
            "n_words": np.diff(windows.at), "n_removed": np.diff(counts),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        }
        if with_text:
            columns["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
        yield pa.record_batch(columns)

    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    extra = ", kept_text string" if with_text else ""
    return shards.run(removed, f"{fields}, n_words long, n_removed long, kept_sha256 string{extra}", replies)

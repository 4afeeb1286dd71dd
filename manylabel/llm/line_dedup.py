"""Removal of repeated line runs with a suffix array over line numbers.

Every text is a sequence of lines. The suffixes of all sequences are ranked by distributed prefix
doubling: a suffix of a repeated line is ranked by its line, then by the pair of its own rank and
the rank of the suffix ``h`` lines on, with ``h`` doubling up to the wanted run. Ranks are places
in the order of all suffixes still repeated, since lists merge in ranges of the order, and ranges
are numbered through. Suffixes with a unique prefix drop out. After the last step, suffixes of one
rank are an interval of the suffix array whose common prefix has at least ``min_lines`` lines: a
repeated run. Its earliest place (by id, then line) stays; the lines of all later places go, so
maximal runs go as one piece. A repeated line of at least ``long_line`` bytes is a run by itself,
whatever stands beside it.

Lines end at 0x0A. Defined results: a null text stays null with zero lines, an empty text has zero
lines; a null id counts as the largest; rows of one id never remove each other's lines at the same
place, so repeated rows stay alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from manylabel.llm.batches import pieces, utf8
from manylabel.llm.exchange import SENT, Shards, merged, prefix_hash, range_hash, sent

LAST = np.iinfo(np.int64).max
#: Bytes from which a repeated line counts without a repeated neighbour (some ten words).
LONG_LINE = 64
BYTE_VALUES = np.random.default_rng(411).integers(1, 1 << 63, 256).astype(np.uint64)


def steps(min_lines: int) -> list[tuple[int, int]]:
    """``(length, shift)`` of each doubling: prefixes of ``length`` lines are pairs ``shift`` apart."""
    out, length = [], 1
    while length < min_lines:
        shift = min(length, min_lines - length)
        length += shift
        out.append((length, shift))
    return out


class Lines:
    """Lines of a shard's texts, their hashes and their places."""

    def __init__(self, rows: pa.StructArray, text: str, key: str):
        self.data, self.offsets = utf8(rows.field(text))
        ends = np.flatnonzero(self.data == 10)
        full = np.flatnonzero(np.diff(self.offsets) > 0)
        closing = np.concatenate([ends * 2, self.offsets[full + 1] * 2 - 1])
        order = np.argsort(closing, kind="stable")
        self.ends = np.concatenate([ends, self.offsets[full + 1]])[order]
        owner = np.concatenate([np.searchsorted(self.offsets, ends, "right") - 1, full])[order]
        self.at = np.searchsorted(owner, np.arange(len(self.offsets)))
        first = np.ones(len(owner), bool)
        first[1:] = owner[1:] != owner[:-1]
        self.starts = np.empty(len(owner), np.int64)
        self.starts[1:] = self.ends[:-1] + 1
        self.starts[first] = self.offsets[owner[first]]
        self.owner = owner
        self.number = np.arange(len(owner)) - self.at[owner]
        ids = rows.field(key).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        self.document = ids[owner]
        self.hashes = range_hash(prefix_hash(BYTE_VALUES[self.data], 0x9E3779B97F4A7C15), self.starts, self.ends)


def _spread(first: np.ndarray, second: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Keys in the order of ``(first, second)`` that fill the range of 64 bits evenly."""
    place = first - 1 + (second.astype(np.float64) / (total + 1)) * size
    return (place * (2.0**63 / (total + 1))).astype(np.uint64) * np.uint64(2)


def _ranked(lists: list[dict]) -> list[bytes]:
    """Place of each repeated entry among those of this range, its group's size; 0 if unique.

    An answer starts with the number of repeated suffixes of the range.
    """
    low = [np.frombuffer(x["low"], np.uint64) for x in lists]
    a = np.concatenate(low)
    b = np.concatenate([np.frombuffer(x["high"], np.uint64) for x in lists])
    n = np.concatenate([np.frombuffer(x["extra"], np.int64) for x in lists])
    order = np.lexsort([b, a])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    group = np.cumsum(fresh) - 1
    size = np.bincount(group, n[order]).astype(np.int64)
    size[size < 2] = 0
    before = np.concatenate([[0], np.cumsum(size)[:-1]]) + 1
    rank, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    rank[order], many[order] = np.where(size > 0, before, 0)[group], size[group]
    total = int(size.sum())
    cuts = np.cumsum([len(x) for x in low])[:-1]
    return [np.concatenate([[total], r, s]).astype(np.int64).tobytes() for r, s in zip(np.split(rank, cuts), np.split(many, cuts))]


def _first(lists: list[dict]) -> list[bytes]:
    """For each entry, whether another list has the same hash at an earlier place."""
    low = [np.frombuffer(x["low"], np.uint64) for x in lists]
    a = np.concatenate(low)
    document = np.concatenate([np.frombuffer(x["high"], np.int64) for x in lists])
    line = np.concatenate([np.frombuffer(x["extra"], np.int64) for x in lists])
    order = np.lexsort([line, document, a])
    fresh = np.ones(len(order), bool)
    fresh[1:] = a[order[1:]] != a[order[:-1]]
    lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    later = np.empty(len(order), np.uint8)
    later[order] = (document[order] != document[lead]) | (line[order] != line[lead])
    return [x.tobytes() for x in np.split(later, np.cumsum([len(x) for x in low])[:-1])]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each distinct combination in order, each row's combination, and the counts."""
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    fresh[1:] = ~same
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return order[fresh], back, np.bincount(back, minlength=int(fresh.sum()))


def remove_repeated_lines(
    docs: DataFrame, min_lines: int = 2, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False,
    long_line: int | None = None,
) -> DataFrame:
    """``keep`` columns, ``n_lines``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of what stays.

    Runs have at least ``min_lines`` lines, or one line of ``long_line`` bytes (null: never one
    line). ``n_spans`` counts the maximal runs of removed lines. ``with_text`` adds ``kept_text``, the lines that stay.
    """
    shards = Shards(docs.select(*dict.fromkeys([*keep, key, text])), text, label="lines")
    parts = shards.parts(shards.n_bytes / 40)
    doublings = steps(min_lines)
    ranges: list[np.ndarray] = []

    def state(lines: Lines, answers: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank (0: unique) and group size of each suffix after the answered steps, and its line's rank."""
        rank = size = alone = None
        for level in range(len(ranges)):
            live, first, back, keys = ask(lines, level, rank, size)
            rank, size = np.zeros(len(lines.hashes), np.int64), np.zeros(len(lines.hashes), np.int64)
            if len(live):
                got = [np.frombuffer(x, np.int64)[1:] for x in answers[level]]
                part = np.searchsorted(_edges(parts), keys, "right")
                found = np.concatenate([x[: len(x) // 2] for x in got])
                many = np.concatenate([x[len(x) // 2 :] for x in got])
                found = np.where(many > 0, found + ranges[level][part], 0)
                rank[live], size[live] = found[back], many[back]
            alone = rank if level == 0 else alone
        return rank, size, alone

    def ask(lines: Lines, level: int, rank, size):
        """Suffixes to rank at ``level``, one of each distinct entry, and the entries' keys."""
        n = len(lines.hashes)
        if level == 0:
            live = np.arange(n)
            first, back, _ = _distinct(lines.hashes)
            return live, first, back, lines.hashes[first]
        _, shift = doublings[level - 1]
        live = np.flatnonzero((rank > 0) & (np.arange(n) + shift < lines.at[lines.owner + 1]))
        live = live[rank[live + shift] > 0]
        keys = _spread(rank[live], rank[live + shift], size[live], int(ranges[level - 1][-1]))
        first, back, _ = _distinct(keys, rank[live], rank[live + shift])
        return live, live[first], back, keys[first]

    replies = None
    for level in range(len(doublings) + 1):

        def send(shard: int, rows: pa.StructArray, answers: dict, level=level) -> Iterator[pa.RecordBatch]:
            lines = Lines(rows, text, key)
            rank, size, _ = state(lines, answers)
            live, first, back, keys = ask(lines, level, rank, size)
            if not len(live):
                return
            if level:
                shift = doublings[level - 1][1]
                a, b = rank[first].astype(np.uint64), rank[first + shift].astype(np.uint64)
            else:
                a, b = keys, np.zeros(len(keys), np.uint64)
            yield from sent(shard, level, parts, keys, a, b, np.bincount(back, minlength=len(first)))

        answer = merged(shards.run(send, SENT, replies), _ranked)
        totals = np.zeros(parts + 1, np.int64)
        for part, total in _totals(answer):
            totals[part + 1] = total
        ranges.append(np.cumsum(totals))
        replies = answer if replies is None else replies.unionByName(answer)

    final = len(doublings) + 1

    def places(lines: Lines, answers: dict):
        """Starts of repeated runs in the order of run, id and line: suffix, run, length, and whether the run is new.

        Runs of one line are numbered behind those of ``min_lines``.
        """
        rank, _, alone = state(lines, answers)
        at = np.flatnonzero(rank > 0)
        run, length = rank[at], np.full(len(at), min_lines)
        if long_line is not None and min_lines > 1:
            single = np.flatnonzero((alone > 0) & (lines.ends - lines.starts >= long_line))
            at = np.concatenate([at, single])
            run = np.concatenate([run, alone[single] + ranges[-1][-1]])
            length = np.concatenate([length, np.ones(len(single), np.int64)])
        order = np.lexsort([lines.number[at], lines.document[at], run])
        at, run, length = at[order], run[order], length[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = run[1:] != run[:-1]
        return at, run, length, fresh

    def mixed(run: np.ndarray) -> np.ndarray:
        total = int(ranges[-1][-1]) + int(ranges[0][-1]) + 1
        return (run.astype(np.float64) * (2.0**63 / total)).astype(np.uint64) * np.uint64(2)

    def earliest(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        lines = Lines(rows, text, key)
        at, run, _, fresh = places(lines, answers)
        lead, name = at[fresh], run[fresh]
        yield from sent(shard, final, parts, mixed(name), name.astype(np.uint64), lines.document[lead], lines.number[lead])

    replies = replies.unionByName(merged(shards.run(earliest, SENT, replies), _first))

    def last(shard: int, rows: pa.StructArray, answers: dict) -> Iterator[pa.RecordBatch]:
        lines = Lines(rows, text, key)
        at, _, length, fresh = places(lines, answers)
        gone = np.zeros(len(lines.hashes) + 1, np.int64)
        if len(at):
            group = np.cumsum(fresh) - 1
            lead = at[fresh][group]
            later = np.frombuffer(b"".join(answers[final]), np.uint8)[group] > 0
            later |= (lines.document[at] != lines.document[lead]) | (lines.number[at] != lines.number[lead])
            np.add.at(gone, at[later], 1)
            np.add.at(gone, at[later] + length[later], -1)
        gone = np.cumsum(gone)[:-1] > 0
        stay = np.flatnonzero(~gone)
        sizes = lines.ends[stay] - lines.starts[stay] + 1
        out = pieces(np.append(lines.data, np.uint8(10)), lines.starts[stay], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out[ends[1:] - 1] = 10
        bounds = ends[np.searchsorted(stay, lines.at)]
        kept = [out[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | (lines.owner[1:] != lines.owner[:-1])
        columns = {k: rows.field(k) for k in keep} | {
            "n_spans": np.diff(np.concatenate([[0], np.cumsum(opens)])[lines.at]),
            "n_lines": np.diff(lines.at), "n_removed": np.diff(np.concatenate([[0], np.cumsum(gone)])[lines.at]),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        }
        if with_text:
            missing = rows.field(text).is_null().to_numpy(zero_copy_only=False)
            columns["kept_text"] = pa.array([x.decode() for x in kept], pa.string(), mask=missing)
        yield pa.record_batch(columns)

    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    extra = ", kept_text string" if with_text else ""
    return shards.run(last, f"{fields}, n_spans long, n_lines long, n_removed long, kept_sha256 string{extra}", replies)


def _edges(parts: int) -> np.ndarray:
    return (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)


def _totals(answers: DataFrame) -> list[tuple[int, int]]:
    """Repeated suffixes of each range: a number for each range."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(np.frombuffer(x.as_py(), np.int64, 1)[0]) for x in batch.column("answer")]
            yield pa.record_batch({"part": batch.column("part"), "total": pa.array(totals, pa.int64())})

    rows = answers.select("part", "answer").mapInArrow(read, "part int, total long").distinct().collect()
    return [(r["part"], r["total"]) for r in rows]

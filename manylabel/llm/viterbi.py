"""Encoding with a SentencePiece vocabulary by streaming Viterbi, and decoding.

The best segmentation has the largest sum of piece scores. Only the last ``max_length`` positions
of a text are needed to go on, so the search keeps that window; whenever the backpointer paths of
all positions in it run through one boundary, the ids before that boundary are final and are
committed. A boundary between two characters that stand side by side in no piece is one that all
paths run through: there a text falls into segments, and the segments of many texts are searched
together in numpy, position by position. Longer segments go through the streaming search.

Characters without a piece become their UTF-8 bytes' pieces. A blank is U+2581 in the pieces; a
U+2581 in the text is coded as bytes, so decoding gives every text back exactly. Ties go to the
shorter last piece. Defined results: null text has null ids, empty text no ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from manylabel.llm.batches import pieces as gather
from manylabel.llm.batches import text_slices

BLANK = 0x2581
#: Stands for a U+2581 of the text; no piece has it.
LITERAL = 0x110000
#: Longest segment of the joint search.
JOINT = 24
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
TABLE_BITS = 18


def _mixed(points: np.ndarray) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1)) * MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Vocabulary:
    """Pieces by id; ``slots`` finds a piece by the hash of its characters."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    plain: list[int]

    def __post_init__(self):
        self.ids = {self.texts[i]: i for i in self.plain}
        self.max_length = max(map(len, self.ids))
        self.unknown = float(self.scores[self.plain].min()) - 10.0
        self.powers = np.ones(JOINT + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(JOINT, BASE))
        codes = {}
        pairs = []
        for text, i in self.ids.items():
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            code = 0
            for m in _mixed(points).tolist():
                code = (code * int(BASE) + m) & (1 << 64) - 1
            codes[code] = i
            pairs.append(points[:-1].astype(np.uint64) << np.uint64(21) | points[1:].astype(np.uint64))
        if len(codes) < len(self.ids):
            raise ValueError("two pieces share a hash")
        self.pairs = np.zeros(1 << 22, bool)
        self.pairs[self._pair_slot(np.concatenate(pairs))] = True
        self.slot_codes = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot_ids = np.full(1 << TABLE_BITS, -1, np.int32)
        self.depth = 1
        for code, i in codes.items():
            slot = (code * int(MIX) & (1 << 64) - 1) >> (64 - TABLE_BITS)
            steps = 1
            while self.slot_ids[slot] >= 0:
                slot = (slot + 1) & ((1 << TABLE_BITS) - 1)
                steps += 1
            self.slot_codes[slot], self.slot_ids[slot] = code, i
            self.depth = max(self.depth, steps)
        spoken = [b""] * len(self.texts)
        for i in self.plain:
            spoken[i] = self.texts[i].replace("▁", " ").encode()
        for value, i in enumerate(self.byte_ids):
            spoken[i] = bytes([value])
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_lengths = np.array([len(x) for x in spoken])
        self.spoken_starts = np.concatenate([[0], np.cumsum(self.spoken_lengths)])[:-1]

    @staticmethod
    def _pair_slot(pair: np.ndarray) -> np.ndarray:
        return (pair * BASE) >> np.uint64(42)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 where there is none."""
        slot = ((codes * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = np.where(self.slot_codes[slot] == codes, self.slot_ids[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self.slot_ids[slot] >= 0))
        for _ in range(1, self.depth):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
            hit = self.slot_codes[slot[open_]] == codes[open_]
            found[open_[hit]] = self.slot_ids[slot[open_[hit]]]
            open_ = open_[~hit & (self.slot_ids[slot[open_]] >= 0)]
        return found

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.spoken, self.spoken_starts[ids], self.spoken_lengths[ids])


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1)
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(texts[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary(texts, np.array([model.get_score(i) for i in range(n)]), byte_ids, plain)


class StreamingEncoder:
    """Viterbi over a stream of characters; ``feed`` gives the ids that have become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.start = 0
        self.buffer = ""
        self.best: dict[int, float] = {0: 0.0}
        self.back: dict[int, tuple[int, int]] = {}
        self.end = 0

    def feed(self, text: str) -> list[int]:
        ids, scores = self.vocabulary.ids, self.vocabulary.scores
        longest, out = self.vocabulary.max_length, []
        for char in text:
            self.buffer += char
            self.end += 1
            top, choice = None, None
            for length in range(1, min(longest, self.end - self.start) + 1):
                before = self.best.get(self.end - length)
                if before is None:
                    continue
                piece = ids.get(self.buffer[-length:])
                if piece is None and length > 1:
                    continue
                score = before + (self.vocabulary.unknown if piece is None else float(scores[piece]))
                if top is None or score > top:
                    top, choice = score, (length, -1 if piece is None else piece)
            self.best[self.end], self.back[self.end] = top, choice
            if self.end - self.start > 4 * longest and self.end % longest == 0:
                out += self._commit()
        return out

    def _commit(self, last: bool = False) -> list[int]:
        """Ids up to the boundary that the paths of all positions in the window share."""
        oldest = self.end if last else max(self.start, self.end - self.vocabulary.max_length + 1)
        alive = set(range(oldest, self.end + 1))
        while len(alive) > 1:
            far = max(alive)
            alive.discard(far)
            alive.add(far - self.back[far][0])
        boundary = at = alive.pop()
        path = []
        while at > self.start:
            length, piece = self.back[at]
            path.append((at - length, piece))
            at -= length
        out = []
        for at, piece in reversed(path):
            if piece >= 0:
                out.append(piece)
            else:
                char = self.buffer[at - self.start]
                char = "▁" if ord(char) == 0xE000 and at in self.literal else char
                out += self.vocabulary.byte_ids[list(char.encode())].tolist()
        keep = boundary - self.start
        self.buffer = self.buffer[keep:]
        for position in range(self.start, boundary):
            self.best.pop(position, None)
            self.back.pop(position + 1, None)
        self.start = boundary
        return out

    literal: frozenset[int] = frozenset()

    def finish(self) -> list[int]:
        return self._commit(last=True)


def encode_stream(vocabulary: Vocabulary, parts: Iterable[str]) -> Iterator[list[int]]:
    """Ids of a text that comes in parts, given out as they become final."""
    encoder = StreamingEncoder(vocabulary)
    for part in parts:
        marked, at = [], encoder.end
        for i, char in enumerate(part):
            if char == "▁":
                encoder.literal |= {at + i}
            marked.append("\ue000" if char == "▁" else "▁" if char == " " else char)
        yield encoder.feed("".join(marked))
    yield encoder.finish()


def _joint(vocabulary: Vocabulary, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each segment, one after the other, and how many each has."""
    n, width = len(starts), int(lengths.max())
    chars = np.full((width, n), LITERAL, np.uint32)
    for i in range(width):
        live = lengths > i
        chars[i, live] = points[starts[live] + i]
    codes = np.zeros((width + 1, n), np.uint64)
    best = np.zeros((width + 1, n))
    step = np.zeros((width + 1, n), np.int8)
    piece = np.full((width + 1, n), -1, np.int32)
    scores = vocabulary.scores
    for i in range(1, width + 1):
        codes[i] = codes[i - 1] * BASE + _mixed(chars[i - 1])
        live = np.flatnonzero(lengths >= i)
        top = np.full(len(live), -np.inf)
        for size in range(1, min(i, vocabulary.max_length) + 1):
            code = codes[i, live] - codes[i - size, live] * vocabulary.powers[size]
            found = vocabulary.find(code)
            value = best[i - size, live] + np.where(found >= 0, scores[found], vocabulary.unknown if size == 1 else -np.inf)
            better = value > top
            top[better] = value[better]
            at = live[better]
            step[i, at], piece[i, at] = size, found[better]
        best[i, live] = top
    at = lengths.astype(np.int64).copy()
    slot = np.arange(n)
    chosen = np.full((width, n), -2, np.int64)
    for i in range(width):
        live = np.flatnonzero(at > 0)
        if not len(live):
            break
        picked = piece[at[live], live]
        chosen[i, live] = np.where(picked >= 0, picked, -3 - chars[at[live] - 1, live].astype(np.int64))
        at[live] -= step[at[live], live]
    count = (chosen != -2).sum(axis=0)
    flat = chosen[::-1].T[(chosen[::-1] != -2).T]
    return _with_bytes(vocabulary, flat, np.repeat(slot, count), n)


def _with_bytes(vocabulary: Vocabulary, flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece (coded as ``-3 - character``) as ids of their bytes."""
    raw = np.flatnonzero(flat < 0)
    if not len(raw):
        return flat, np.bincount(owner, minlength=n)
    point = -3 - flat[raw]
    point[point == LITERAL] = BLANK
    spelled = [chr(p).encode() for p in point.tolist()]
    width = np.ones(len(flat), np.int64)
    width[raw] = [len(x) for x in spelled]
    out = np.repeat(flat, width)
    out[out < 0] = vocabulary.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    return out, np.bincount(np.repeat(owner, width), minlength=n)


def encode_texts(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, one after the other, and each text's offsets into them."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points[points == BLANK] = LITERAL
    points[points == 0x20] = BLANK
    wide = points.astype(np.uint64)
    first = np.ones(len(points), bool)
    first[1:] = ~vocabulary.pairs[vocabulary._pair_slot(wide[:-1] << np.uint64(21) | wide[1:])]
    first[begins[:-1][begins[:-1] < len(points)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(points)))
    code = np.zeros(len(starts), np.uint64)
    short = lengths <= JOINT
    mixed = _mixed(points)
    for i in range(int(lengths[short].max()) if short.any() else 0):
        live = np.flatnonzero(short & (lengths > i))
        code[live] = code[live] * BASE + mixed[starts[live] + i]
    known, sample, kind = np.unique(code[short], return_index=True, return_inverse=True)
    ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(known):
        s, length = starts[short][sample], lengths[short][sample]
        order = np.argsort(-length, kind="stable")
        got, many = [], np.zeros(len(known), np.int64)
        for a in range(0, len(order), 1 << 15):
            part = order[a : a + (1 << 15)]
            x, c = _joint(vocabulary, points, s[part], length[part])
            got.append(x)
            many[part] = c
        ids = np.concatenate(got)
        at = np.zeros(len(known), np.int64)
        at[order] = np.concatenate([[0], np.cumsum(many[order])[:-1]])
        counts = many
    else:
        at = counts
    total = np.zeros(len(starts), np.int64)
    total[short] = counts[kind]
    place = np.zeros(len(starts), np.int64)
    place[short] = at[kind]
    extra, size = [], len(ids)
    for i in np.flatnonzero(~short):
        part = points[starts[i] : starts[i] + lengths[i]]
        part = np.where(part == LITERAL, BLANK, np.where(part == BLANK, 0x20, part)).astype(np.uint32)
        text = part.tobytes().decode("utf-32-le", "surrogatepass")
        found = [x for out in encode_stream(vocabulary, [text]) for x in out]
        extra.append(np.array(found, np.int64))
        place[i], total[i] = size, len(found)
        size += len(found)
    ids = np.concatenate([ids, *extra])
    ends = np.concatenate([[0], np.cumsum(total)])
    return gather(ids, place, total), ends[np.searchsorted(starts, begins)]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` and ``round_trip``: whether decoding gave the same bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, text):
                ids, at = encode_texts(shared.value, data, offsets)
                ends = np.concatenate([[0], np.cumsum(shared.value.spoken_lengths[ids])])[at]
                back = shared.value.bytes_of(ids)
                same = np.diff(ends) == np.diff(offsets)
                if len(back) == len(data):
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same &= wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    same &= [back[ends[i] : ends[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(rows))]
                missing = rows.column(text).is_null()
                lists = pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32), mask=missing)
                yield pa.record_batch({k: rows.column(k) for k in keep} | {"ids": lists, "round_trip": same})

    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(encode, f"{fields}, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text``; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if row is None else shared.value.bytes_of(np.asarray(row, np.int64)).tobytes().decode("utf-8", "replace")
                for row in batch.column(ids).to_pylist()
            ]
            yield pa.record_batch({k: batch.column(k) for k in keep} | {"text": pa.array(texts, pa.string())})

    fields = ", ".join(f"`{k}` {t}" for k, t in encoded.select(*keep).dtypes)
    return encoded.select(*dict.fromkeys([*keep, ids])).mapInArrow(decode, f"{fields}, text string")

"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped under forms.

Every distinct prefix of the words is a node of the forward trie, every suffix one of the trie of
reversed words. Both tries are numbered from sorted words: a word brings in the nodes
deeper than what it shares with the word before it, so one pass over a sorted range numbers them,
and only the path at the end of a range is told to the next one. A word without position ``i`` is
then the integer pair (node of what stands before ``i``, node of what stands after it), and a word
with a gap at ``i`` the pair (node before, node after the gap). Words with an equal skipped pair
differ by one replacement; a skipped pair equal to a gap is one deletion. Pairs are equal exactly if
the strings are, so nothing is checked again.

Only nodes that several words share can meet, so positions outside the shared part of both tries
send no pair. Words of one skipped pair differ in a single position, so there are no more of them
than the alphabet has letters, and at most one word has that gap. A pair gives each of its words
the number of the others and the best of them; pairs of words are never rows.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count
is at least ``ratio`` times its own. Forms are followed to the last by doubling.

Defined results: words are distinct and not null; null counts count as 0; a null text has no word;
long words are words like any other; rows with equal id and text are counted as often as they
stand there; an empty table gives an empty result; columns not named take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manylabel.session import shuffle_width, stage

#: Code points of the words that one range of a trie holds, and ranges at least.
RANGE_LETTERS = 4_000_000
LETTERS = r"[A-Za-zÀ-ÿ]+"


# --- tries --------------------------------------------------------------------


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and ``len + 1`` offsets into them."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def shared_with_next(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each word and the next."""
    lengths = np.diff(offsets)
    limit = np.minimum(lengths[:-1], lengths[1:])
    out = np.zeros(len(limit), np.int64)
    alive = np.flatnonzero(limit > 0)
    while len(alive):
        d = out[alive]
        alive = alive[codes[offsets[alive] + d] == codes[offsets[alive + 1] + d]]
        out[alive] += 1
        alive = alive[out[alive] < limit[alive]]
    return out


def shared_with(codes: np.ndarray, offsets: np.ndarray, other: str | None) -> np.ndarray:
    """Length of the common prefix of each word and ``other``."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.int64)
    alive = np.flatnonzero(lengths > 0)
    for code in (ord(c) for c in other or ""):
        alive = alive[codes[offsets[alive] + out[alive]] == code]
        out[alive] += 1
        alive = alive[out[alive] < lengths[alive]]
        if not len(alive):
            break
    return out


def number_nodes(codes: np.ndarray, offsets: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Node of every prefix of sorted words, at ``offsets[i] + length - 1``, and each word's
    longest prefix shared with a neighbour. Numbers start at ``first``."""
    lengths = np.diff(offsets)
    n = len(lengths)
    common = shared_with_next(codes, offsets) if n else np.zeros(0, np.int64)
    before = np.concatenate([[0], common]) if n else common
    nodes = np.zeros(len(codes), np.int64)
    alive, depth = np.arange(n), 1
    while len(alive := alive[lengths[alive] >= depth]):
        # The word that brought the node in: the last one that shares less with its predecessor.
        fresh = before[alive] < depth
        opened = np.maximum.accumulate(np.where(fresh, np.arange(len(alive)), 0))
        nodes[offsets[alive] + depth - 1] = first + offsets[alive[opened]] + depth - 1
        depth += 1
    shared = np.maximum(before, np.concatenate([common, [0]])) if n else before
    return nodes, shared


def trie(words: DataFrame, column: str, letters: int) -> DataFrame:
    """``(word, nodes, shared)``: numbers of all prefixes of ``column``, 0 being the root.

    Words are sorted into ranges and numbered range by range; numbers of prefixes that began in an
    earlier range are put right from the paths at the ends of the ranges, a word each.
    """
    width = max(shuffle_width(words.sparkSession), -(-letters // RANGE_LETTERS))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        part = TaskContext.get().partitionId()
        codes, offsets = _codes(rows.column("key").combine_chunks())
        nodes, shared = number_nodes(codes, offsets, (part << 40) + 1)
        yield pa.record_batch({
            "part": np.full(len(rows), part, np.int32), "word": rows.column("word").combine_chunks(), "key": rows.column("key").combine_chunks(),
            "nodes": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(nodes)), "shared": shared.astype(np.int32),
        })

    keyed = words.select("word", F.col(column).alias("key"))
    ordered = keyed.repartitionByRange(width, "key").sortWithinPartitions("key")
    ranges = stage(ordered.mapInArrow(numbered, "part int, word string, key string, nodes array<long>, shared int"), "trie")
    ends = ranges.groupBy("part").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("nodes", "key").alias("path")
    ).orderBy("part").collect()  # two words and a path a range
    edges: dict[int, tuple[str | None, np.ndarray, str | None]] = {}
    path, last = np.zeros(0, np.int64), None
    for k, r in enumerate(ends):
        edges[r["part"]] = (last, path, ends[k + 1]["first"] if k + 1 < len(ends) else None)
        own = np.array(r["path"], np.int64)
        same = _common(last, r["last"])
        path, last = np.concatenate([path[:same], own[same:]]), r["last"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                rows = batch.filter(pa.array(parts == part))
                before, carried, after = edges[part]
                codes, offsets = _codes(rows.column("key"))
                nodes = rows.column("nodes").flatten().to_numpy(zero_copy_only=False).copy()
                reach = shared_with(codes, offsets, before)
                deep = np.repeat(reach, reach)
                at = np.arange(len(deep)) - np.repeat(np.cumsum(reach) - reach, reach)
                nodes[np.repeat(offsets[:-1], reach) + at] = carried[at]
                shared = np.maximum(np.maximum(reach, shared_with(codes, offsets, after)), rows.column("shared").to_numpy())
                yield pa.record_batch({
                    "word": rows.column("word"), "nodes": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(nodes)),
                    "shared": shared.astype(np.int32),
                })

    return ranges.select("part", "word", "key", "nodes", "shared").mapInArrow(joined, "word string, nodes array<long>, shared int")


def _common(a: str | None, b: str) -> int:
    n = 0
    while a is not None and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


# --- near words and forms -----------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """``(id, word, n, n_near, best_n, best)`` of distinct ``(word, n)``; ``best`` is an id.

    Ids follow the order of the words.
    """
    words = words.select("word", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    width = max(shuffle_width(words.sparkSession), -(-letters // RANGE_LETTERS))
    ranked = words.repartitionByRange(width, "word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    ranked = stage(ranked.withColumn("back", F.reverse("word")), "words")
    forward = trie(ranked, "word", letters).select("word", F.col("nodes").alias("front"), F.col("shared").alias("front_shared"))
    backward = trie(ranked, "back", letters).select("word", F.col("nodes").alias("rear"), F.col("shared").alias("rear_shared"))
    both = ranked.join(forward, "word").join(backward, "word")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                yield _pairs(batch.slice(a, 4096))

    schema = "p long, s long, id long, n long, kind int"
    pairs = both.select("id", "word", "n", "front", "rear", "front_shared", "rear_shared").mapInArrow(paired, schema)
    member = F.struct((-F.col("n")).alias("least"), "id", "kind")
    met = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("words")).filter(F.size("words") > 1)
    # kind 0: skipped; 1: skipped at the first of equal letters, where deletions count; 2: gap.
    told = met.select(F.inline(F.transform("words", lambda w: F.struct(w["id"].alias("id"), F.filter(
        "words", lambda v: (v["id"] != w["id"]) & F.when(w["kind"] == 2, v["kind"] == 1).when(w["kind"] == 0, v["kind"] < 2).otherwise(F.lit(True))
    ).alias("others")))))
    told = told.filter(F.size("others") > 0).select("id", F.size("others").alias("others"), F.array_min("others").alias("top"))
    near = told.groupBy("id").agg(F.sum("others").alias("n_near"), F.min(F.struct("top.least", "top.id")).alias("top"))
    return ranked.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("top.least")).alias("best_n"), F.col("top.id").alias("best")
    )


def _pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The skipped and gap pairs of some words inside the shared parts of both tries."""
    codes, offsets = _codes(rows.column("word"))
    lengths = np.diff(offsets)
    front = rows.column("front").flatten().to_numpy(zero_copy_only=False)
    rear = rows.column("rear").flatten().to_numpy(zero_copy_only=False)
    most, least = rows.column("front_shared").to_numpy(), lengths - rows.column("rear_shared").to_numpy()
    ids, counts = rows.column("id").to_numpy(), rows.column("n").to_numpy()

    def prefix(word, length):
        return np.where(length > 0, front[np.minimum(offsets[word] + np.maximum(length, 1) - 1, len(front) - 1)], 0)

    def suffix(word, length):
        return np.where(length > 0, rear[np.minimum(offsets[word] + np.maximum(length, 1) - 1, len(rear) - 1)], 0)

    out = []
    for gap in (0, 1):
        # Prefix of length i, then a letter that is left out unless this is a gap, then the rest.
        low = np.maximum(least - 1 + gap, 0)
        high = np.minimum(most, lengths - 1 + gap)
        size = np.maximum(high - low + 1, 0)
        word = np.repeat(np.arange(len(lengths)), size)
        i = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        kind = np.full(len(word), 2)
        if not gap and len(word):
            at = offsets[word] + i
            kind = ((i == 0) | (codes[at] != codes[np.maximum(at - 1, 0)])).astype(np.int64)
        out.append((prefix(word, i), suffix(word, lengths[word] - i - (1 - gap)), ids[word], counts[word], kind))
    p, s, w, n, kind = (np.concatenate(x) for x in zip(*out))
    return pa.record_batch({"p": p.astype(np.int64), "s": s.astype(np.int64), "id": w, "n": n, "kind": kind.astype(np.int32)})


def group_words(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of distinct ``(word, n)``."""
    near = stage(near_words(words), "near")
    formed = F.col("best_n") >= ratio * F.col("n")
    named = near.select("id", "word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    links = stage(named.filter("form IS NOT NULL").select("id", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "forms")
        links = moved.select("id", "root")
        if moved.filter("open").isEmpty():
            break
    spelled = near.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    rooted = near.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    return named.join(links, "id", "left").join(spelled, "form", "left").join(rooted, "root", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )


# --- words of documents -------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def count_words(docs: DataFrame, noise: int | None = None, min_letters: int = 5, min_count: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased, with their number of occurrences.

    With ``noise``, a run of a document loses a letter where ``noise`` divides the checksum of
    ``<id>:<run>``; which letter follows from the checksum too. A null id is an empty text there.
    """
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    runs = docs.select(named.alias("key"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(0))).alias("run"))
    if noise is not None:
        mark = F.crc32(F.concat("key", F.lit(":"), "run"))
        at = (mark % F.length("run")).cast("int")
        short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + F.lit(2), F.length("run")))
        runs = runs.select(F.when(mark % noise == 0, short).otherwise(F.col("run")).alias("run"))
    counted = runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= min_letters) & (F.col("n") >= min_count))

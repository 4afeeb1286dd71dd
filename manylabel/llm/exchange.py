"""Texts in shards, and the exchange of sorted hashes between them.

A shard is a row with some documents, a few megabytes of text, staged once in a table bucketed by
shard. To learn something about its hashes from all other shards, a shard sends them, sorted and
each once, cut by hash range; the task of a range merges the lists of all shards and answers every
list with one small array in the same order, which goes back to the shard. So a frequent hash is
one entry for each shard, texts never move again, and an answer costs bits, not rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.batches import slices, utf8
from manylabel.session import made, shuffle_width, stage, staging_root

SHARD_BYTES = 2_000_000
#: Text of one bucket of the staged table, and hashes that one merging task gets.
BUCKET_BYTES = 32_000_000
RANGE_ENTRIES = 2_000_000

SENT = "part int, shard long, level int, low binary, high binary, extra binary"
REPLY = "part int, shard long, level int, answer binary"


class Shards:
    """Documents in shards. ``docs`` may have any columns; ``text`` names the text."""

    def __init__(self, docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, label: str = "shards"):
        spark = docs.sparkSession
        at = docs.columns.index(text)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            partition, number = TaskContext.get().partitionId(), 0
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                for a, b in slices(offsets, shard_bytes):
                    rows = batch.slice(a, b - a)
                    struct = pa.StructArray.from_arrays(rows.columns, names=rows.schema.names)
                    yield pa.record_batch({
                        "shard": pa.array([partition << 32 | number], pa.int64()),
                        "docs": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), struct),
                    })
                    number += 1

        row = docs.schema.simpleString()
        self.n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        shards = docs.mapInArrow(packed, f"shard long, docs array<{row}>")
        width = max(shuffle_width(spark), -(-self.n_bytes // BUCKET_BYTES))
        name = f"{label}_{uuid.uuid4().hex}"
        made(f"{staging_root(spark)}/{name}", name)
        shards.repartition(width, "shard").write.bucketBy(width, "shard").option(
            "path", f"{staging_root(spark)}/{name}"
        ).saveAsTable(name)
        self.table = spark.table(name)
        self.schema = docs.schema
        self.text = text

    def parts(self, entries: float) -> int:
        """Hash ranges for about ``entries`` hashes."""
        return max(1, int(-(-entries // RANGE_ENTRIES)))

    def run(self, work: Callable[[int, pa.Table, dict], Iterator[pa.RecordBatch]], schema: str, replies: DataFrame | None = None) -> DataFrame:
        """``work(shard, docs, answers)`` for each shard; ``answers[level]`` are in range order."""
        shards = self.table
        if replies is not None:
            gathered = replies.groupBy("shard").agg(F.collect_list(F.struct("level", "part", "answer")).alias("answers"))
            shards = shards.join(gathered.hint("shuffle_hash"), "shard", "left")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    docs = batch.column("docs")[i].values
                    answers: dict[int, list] = {}
                    if "answers" in batch.schema.names:
                        for x in batch.column("answers")[i].as_py() or []:
                            answers.setdefault(x["level"], []).append((x["part"], x["answer"]))
                    answers = {k: [a for _, a in sorted(v)] for k, v in answers.items()}
                    yield from work(batch.column("shard")[i].as_py(), docs, answers)

        return shards.mapInArrow(each, schema)


def sent(shard: int, level: int, parts: int, keys: np.ndarray, low: np.ndarray, high: np.ndarray | None = None, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a shard's sorted ``keys``, cut into ``parts`` hash ranges."""
    bounds = range_bounds(keys, parts)
    for part in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[part], bounds[part + 1]
        yield pa.record_batch({
            "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int64()), "level": pa.array([level], pa.int32()),
            "low": pa.array([low[a:b].tobytes()], pa.binary()),
            "high": pa.array([None if high is None else high[a:b].tobytes()], pa.binary()),
            "extra": pa.array([None if extra is None else extra[a:b].tobytes()], pa.binary()),
        })


def range_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range starts in sorted ``keys``."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def merged(rows: DataFrame, merge: Callable[[list[dict]], list[bytes]]) -> DataFrame:
    """Merge the lists of each hash range; ``merge`` gives one answer for each list.

    The answers are staged, as later passes over the shards read them again.
    """

    def work(table: pa.Table) -> pa.Table:
        lists = table.select(["shard", "level", "low", "high", "extra"]).to_pylist()
        answers = merge(lists)
        return pa.table({
            "part": table.column("part"), "shard": table.column("shard"), "level": table.column("level"),
            "answer": pa.array(answers, pa.binary()),
        })

    return stage(rows.groupBy("part").applyInArrow(work, REPLY), "answers")


def prefix_hash(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over ``values``, and the powers that shift a range to zero."""
    n = len(values)
    step, back = np.uint64(base | 1), np.uint64(pow(base | 1, -1, 1 << 64))
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), step)]))[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers, out=total[1:])
    shift = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, back)]))
    return total, shift


def range_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[starts[i]:ends[i]]``, well mixed."""
    total, shift = prefix
    x = (total[ends] - total[starts]) * shift[starts]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))

"""Near duplicates among embeddings by p-stable hashing, with an exact check of every link.

Normalised vectors are projected on Gaussian directions and the projections cut into cells of one
width; ``hashes`` cells make a bucket of one table. How many hashes a table takes follows from the
number of different vectors, how many tables from the wanted recall at the threshold. Equal
vectors are one entry with a count. In a bucket all pairs are compared by blocks of a matrix
product; a unit gives, for each entry, the sum of the copies linked and the smallest entry
reachable. A pair that meets in several tables counts in the first one only.

Defined results: null, zero, or non-finite vectors, or such with null components, link with
nothing; vectors of different lengths never link; rows with a null id take part in nothing and
have a null component; repeated rows of an id are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.llm.buckets import by_unit, components, in_units, local_components
from manylabel.llm.tree_search import exact_scores, matrix, unit, usable
from manylabel.session import stage

BLOCK = 1024
#: Cell width, and the random pairs that a vector may meet in a bucket.
WIDTH = 2.0
MATES = 64


def collision(gap: float, width: float = WIDTH) -> float:
    """Probability that one hash is equal for two vectors ``gap`` apart."""
    r = width / gap
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_sizes(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hashes of a table and number of tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    hashes = max(4, round(math.log(max(1.0, n / MATES)) / -math.log(far)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


def _signed(hashes: int, tables: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == size))
                rng = np.random.default_rng([seed, size])
                directions = rng.normal(size=(size, hashes * tables))
                shift = rng.uniform(0, WIDTH, hashes * tables)
                salt = rng.integers(1, 1 << 62, hashes).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                for a in range(0, len(rows), 1024):
                    part = rows.slice(a, 1024)
                    cells = np.floor((unit(matrix(part.column("vector"))) @ directions + shift) / WIDTH).astype(np.int64)
                    code = (cells.reshape(len(part), tables, hashes).view(np.uint64) * salt).sum(axis=2, dtype=np.uint64)
                    code ^= code >> np.uint64(31)
                    flat = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()
                    lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, tables, dtype=np.int32), flat)
                    yield pa.record_batch({"id": part.column("id"), "copies": part.column("copies"), "vector": part.column("vector"), "sign": lists})

    return sign


def _linked(threshold: float):
    keys = ["at", "cell", "size", "lo", "hi"]

    def link(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        at, mine, lo, hi = (rows.column(c).to_numpy() for c in ("at", "mine", "lo", "hi"))
        out: list[tuple] = []
        for a, b in zip(starts[:-1], starts[1:]):
            part = rows.slice(a, b - a)
            raw = matrix(part.column("vector"))
            x = unit(raw)
            own = mine[a:b]
            if lo[a] == hi[a]:
                i, j = np.nonzero(np.triu(x @ x.T >= threshold - 1e-9, 1))
            else:
                left, right = np.flatnonzero(own == lo[a]), np.flatnonzero(own == hi[a])
                if not len(left) or not len(right):
                    continue
                i, j = np.nonzero(x[left] @ x[right].T >= threshold - 1e-9)
                i, j = left[i], right[j]
            if not len(i):
                continue
            keep = np.concatenate([exact_scores(raw[i[c : c + 65536]], raw[j[c : c + 65536]]) >= threshold for c in range(0, len(i), 65536)])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            sign = matrix(part.column("sign")).astype(np.int32)[:, : at[a]]
            fresh = np.concatenate([
                ~(sign[i[c : c + 65536]] == sign[j[c : c + 65536]]).any(axis=1) for c in range(0, len(i), 65536)
            ])
            n = b - a
            label = local_components(n, i, j)
            add = np.bincount(i[fresh], copies[a:b][j[fresh]], n) + np.bincount(j[fresh], copies[a:b][i[fresh]], n)
            met = np.unique(np.concatenate([i, j]))
            out.append((ids[a:b][met], ids[a:b][label[met]], add[met].astype(np.int64)))
        if not out:
            return None
        a, b, add = (np.concatenate(x) for x in zip(*out))
        return pa.record_batch({"a": a, "b": b, "links": add})

    return lambda batches: by_unit(batches, keys, link)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, key: str = "vec_id", column: str = "embedding", seed: int = 11,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``."""
    named = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    known = usable(named, "vector").filter(F.col("vec_id").isNotNull())
    entries = stage(known.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "stable-entries")
    hashes, tables = table_sizes(entries.count(), threshold, recall)
    kind = dict(entries.dtypes)["vector"]
    signed = stage(
        entries.select("id", "copies", "vector").mapInArrow(
            _signed(hashes, tables, seed), f"id long, copies long, vector {kind}, sign array<int>"
        ), "stable-signs",
    )
    spread = signed.select("id", "copies", "vector", "sign", F.size("vector").alias("size"), F.posexplode("sign").alias("at", "cell"))
    links = stage(
        in_units(spread, ["at", "cell", "size"], "id", BLOCK).mapInArrow(_linked(threshold), "a long, b long, links long"), "stable-links"
    )
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(links.select("a", "b"), label="stable-components")
    found = entries.join(counts, "id", "left").join(roots, "id", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    alone = F.when(F.col("vec_id").isNotNull(), F.col("vec_id"))
    joined = named.join(found, (named["vector"] == found["vector"]) & named["vec_id"].isNotNull(), "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), alone)
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )

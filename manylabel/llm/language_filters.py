"""Language identification with one bit-sliced Bloom filter over all languages.

A slot of the filter is a bitmask of languages. Looking an n-gram up costs a few slots and an
AND, whatever the number of languages, and gives all languages that contain the n-gram. The
share of a text's n-grams that each language contains, corrected for the filter's false
positives, decides.

Fitting uses a sample of labelled texts of bounded size (``sample_docs`` for each language,
chosen by a hash of the id); its n-gram counts are summed by Spark, and only ``top_ngrams``
n-grams of each language reach the driver. Scoring reads every byte of every text.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the
first language by name; a table without labelled text gives ``und`` for every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manylabel.llm.batches import sums, text_slices

UNKNOWN = "und"
#: Bytes of an n-gram.
SIZE = 4
SEEDS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def _folding() -> np.ndarray:
    """ASCII letters in lower case, bytes of other letters as they are, the rest a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    letters = np.zeros(256, bool)
    letters[97:123] = letters[65:91] = letters[128:] = True
    table[~letters] = 32
    return table


FOLD = _folding()


def ngram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that starts at each byte, and the offsets of each text's codes.

    Each text gets a blank before and after, so n-grams never cross texts.
    """
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n + SIZE, 32, np.uint8)
    places = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    padded[places] = FOLD[data]
    wide = padded.astype(np.uint32)
    codes = wide[: -SIZE + 1].copy()
    for i in range(1, SIZE):
        codes = (codes << np.uint32(8)) | wide[i : len(wide) - SIZE + 1 + i]
    starts = offsets + 2 * np.arange(n + 1)
    keep = np.zeros(len(codes), bool)
    lengths = np.maximum(np.diff(offsets) + 2 - SIZE + 1, 0)
    live = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    keep[live] = True
    blank = np.uint32(0x2020)
    keep &= ((codes >> np.uint32(16)) != blank) & ((codes & np.uint32(0xFFFF)) != blank)
    counts = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], counts[np.minimum(starts, len(codes))]


@dataclass
class Filters:
    """``slots[i, w]`` holds 64 languages a word; ``rates`` are false-positive rates."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray

    def masks(self, codes: np.ndarray) -> np.ndarray:
        shift = np.uint32(32 - int(len(self.slots)).bit_length() + 1)
        found = None
        for seed in SEEDS:
            mixed = codes ^ (codes >> np.uint32(15))
            slot = (mixed * np.uint32(seed)) >> shift
            found = self.slots[slot] if found is None else found & self.slots[slot]
        return found


def build_filters(ngrams: dict[str, np.ndarray], bits_each: int = 16) -> Filters:
    """Filters of the given n-gram codes by language."""
    languages = sorted(ngrams)
    most = max((len(v) for v in ngrams.values()), default=1)
    size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * bits_each))))
    words = -(-len(languages) // 64) or 1
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((size, words), kind)
    shift = np.uint32(32 - size.bit_length() + 1)
    for i, name in enumerate(languages):
        codes = ngrams[name].astype(np.uint32)
        for seed in SEEDS:
            slot = ((codes ^ (codes >> np.uint32(15))) * np.uint32(seed)) >> shift
            slots[slot, i // 64] |= kind(1 << (i % 64))
    fill = [(slots[:, i // 64] >> kind(i % 64) & kind(1)).mean() for i in range(len(languages))]
    return Filters(languages, slots, np.asarray(fill) ** len(SEEDS))


def _counted(column: str, lang: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, column):
                codes, at = ngram_codes(data, offsets)
                names, who = np.unique(np.array(rows.column(lang).to_pylist(), object), return_inverse=True)
                owner = np.repeat(who, np.diff(at))
                for i, name in enumerate(names):
                    found, n = np.unique(codes[owner == i], return_counts=True)
                    yield pa.record_batch(
                        {"lang": pa.array([name] * len(found), pa.string()), "code": found.astype(np.int64), "n": n.astype(np.int64)}
                    )

    return count


def fit_filters(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
    sample_docs: int = 3000, top_ngrams: int = 2000,
) -> Filters:
    """Fit on about ``sample_docs`` texts of each language, chosen by a hash of ``key``."""
    known = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")
    )
    shares = known.groupBy("lang").count().select("lang", (F.lit(float(sample_docs)) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("text", "lang")
    counts = (
        sample.mapInArrow(_counted("text", "lang"), "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("place", first).filter(F.col("place") <= top_ngrams).select("lang", "code").toPandas()
    return build_filters({k: v.to_numpy(np.uint32) for k, v in rows.groupby("lang")["code"]})


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _scored(filters: Filters, keep: list[str], column: str):
    names = np.array([*filters.languages, UNKNOWN], object)
    rates = filters.rates[:, None]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, column):
                codes, at = ngram_codes(data, offsets)
                masks = filters.masks(codes)
                kind = masks.dtype.type
                total = np.maximum(np.diff(at), 1)
                hits = np.array([
                    sums((masks[:, i // 64] >> kind(i % 64)) & kind(1), at)
                    for i in range(len(filters.languages))
                ]).reshape(len(filters.languages), len(rows))
                share = np.clip((hits / total - rates) / (1 - rates), 0, 1)
                ascii_letters = sums((FOLD[data] > 32) & (data < 128), offsets) > 0
                texts = rows.column(column)
                known = ascii_letters.copy()
                for i in np.flatnonzero(~ascii_letters):
                    known[i] = _has_letter(texts[i].as_py())
                if len(filters.languages):
                    best = share.argmax(axis=0)
                    whole = share.sum(axis=0)
                    top = share.max(axis=0)
                    points = np.where(whole > 0, top / np.where(whole > 0, whole, 1), 1 / len(filters.languages))
                else:
                    best, points, known = np.zeros(len(rows), int), np.zeros(len(rows)), np.zeros(len(rows), bool)
                out = {k: rows.column(k) for k in keep}
                out["lang_pred"] = pa.array(names[np.where(known, best, len(names) - 1)], pa.string())
                out["score"] = pa.array(np.where(known, points, 0.0))
                yield pa.record_batch(out)

    return score


def predict_language(docs: DataFrame, filters: Filters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row, from the whole text."""
    needed = docs.select(*dict.fromkeys([*keep, text]))
    fields = ", ".join(f"`{k}` {t}" for k, t in docs.select(*keep).dtypes)
    return needed.mapInArrow(_scored(filters, list(keep), text), f"{fields}, lang_pred string, score double")

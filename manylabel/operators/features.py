"""Tokens, term counts, vocabularies, TF-IDF and numeric scaling.

Feature tables are long: ``(id, term, tf)`` for counts and ``(id, term, x)`` for weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from manylabel.functions.fixed import WORD_PATTERN
from manylabel.operators.algebra import join_terms
from manylabel.operators.ranks import with_rank
from manylabel.session import block_of, block_width, placed_by_block, shuffle_width, stage, stage_by_block


def token_array(text: Column, pattern: str = WORD_PATTERN, group: int = 0) -> Column:
    """All matches of ``pattern`` (or of one group of it) in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(group))


def tokenize(df: DataFrame, column: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """``(id, pos, term)``: one row per token."""
    return df.select("id", F.posexplode(token_array(F.col(column), pattern)).alias("pos", "term"))


def remove_stopwords(tokens: DataFrame, words: Sequence[str]) -> DataFrame:
    return tokens.filter(~F.col("term").isin(*words)) if words else tokens


def _ngrams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - n
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "),
    )
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def term_counts(
    df: DataFrame, column: str = "text", pattern: str = WORD_PATTERN,
    stop_words: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 1),
    binary: bool = False, carry: Sequence[str] = (), placed: bool = False,
    group: int = 0,
) -> DataFrame:
    """``(id, *carry, term, tf)`` of texts with unique ids; texts in blocks keep their block.

    Texts are placed by id before they are exploded (``placed``: they already are), so
    counting needs no exchange of the much larger token stream, and the result can be
    written bucketed by id as it is.
    """
    block = block_of(df.columns)
    keep = ["id", *carry, *([block] if block else [])]
    texts = df.select(*keep, column)
    if not placed:
        # A task holds the n-grams of its texts, as many times the tokens as there are lengths.
        width = block_width(block) if block else shuffle_width(df.sparkSession) * (ngram_range[1] - ngram_range[0] + 1)
        texts = texts.repartition(width, block or "id")
    tokens = token_array(F.col(column), pattern, group)
    low, high = ngram_range
    if (low, high) != (1, 1):
        rows = texts.select(*keep, F.explode(F.array(tokens)).alias("_t"))
        held = F.col("_t")
        if stop_words:
            listed = F.array(*map(F.lit, stop_words))
            held = F.filter(held, lambda t: ~F.array_contains(listed, t))
            rows = rows.select(*keep, F.explode(F.array(held)).alias("_t"))
        grams = F.concat(*[_ngrams(F.col("_t"), n) for n in range(low, high + 1)])
        rows = rows.select(*keep, F.explode(grams).alias("term"))
    else:
        rows = texts.select(*keep, F.explode(tokens).alias("term"))
        rows = remove_stopwords(rows, stop_words)
    tf = F.lit(1).cast("bigint") if binary else F.count(F.lit(1))
    return rows.groupBy(*keep, "term").agg(tf.alias("tf"))


def doc_freq(counts: DataFrame) -> DataFrame:
    """``(term, df, n)``: documents and occurrences per term."""
    return counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")
    )


def vocabulary(
    counts: DataFrame, n_docs: Column | int, min_df: int | float = 1,
    max_df: int | float = 1.0, max_features: int | None = None,
) -> DataFrame:
    """``(term, df, n)`` of the kept terms; float limits are shares of the documents."""
    terms = doc_freq(counts)
    docs = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    low = docs * min_df if isinstance(min_df, float) else F.lit(min_df)
    high = docs * max_df if isinstance(max_df, float) else F.lit(max_df)
    terms = terms.filter((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        ranked = with_rank(terms, [], [F.col("n").desc(), F.col("term")], "_rn")
        terms = ranked.filter(F.col("_rn") <= max_features).drop("_rn")
    return terms


def term_index(terms: DataFrame) -> DataFrame:
    """Add the zero-based alphabetical position ``idx``."""
    ranked = with_rank(terms, [], [F.col("term")], "_rn")
    return ranked.withColumn("idx", F.col("_rn") - 1).drop("_rn")


def count_vectorize(
    counts: DataFrame, terms: DataFrame | None = None, binary: bool = False
) -> DataFrame:
    """Counts restricted to a vocabulary, with the alphabetical term position."""
    terms = doc_freq(counts) if terms is None else terms
    indexed = term_index(terms.select("term", "df"))
    out = join_terms(counts, indexed)
    tf = F.lit(1).cast("bigint") if binary else F.col("tf")
    out = out.select("id", "term", "idx", tf.alias("tf"))
    if not block_of(counts.columns):
        return out
    with placed_by_block(counts.sparkSession):
        return stage(out, "vectors")


def tfidf(
    counts: DataFrame, n_docs: Column | int, terms: DataFrame | None = None,
    norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True,
    sublinear_tf: bool = False,
) -> DataFrame:
    """``(id, term, x)`` with ``x = tf * (ln((1+n)/(1+df)) + 1)``, rows normalised.

    ``terms`` (``term, df``) fixes vocabulary and document frequencies; by default they
    come from ``counts``. Counts in blocks give weights staged in the same blocks, as their factors,
    which take less room; without ``terms`` they tell the ``lone`` ones, of a single document.
    """
    block = block_of(counts.columns)
    missing = None
    if terms is None:
        terms = doc_freq(counts)
        if block:  # most terms are of one document, which needs no table
            terms, missing = terms.filter("df > 1"), F.struct(F.lit(1).cast("bigint").alias("df"))
    docs = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    extra = F.lit(1 if smooth_idf else 0)
    idf = F.log((docs + extra) / (F.col("df") + extra)) + 1.0 if use_idf else F.lit(1.0)
    weighted = join_terms(counts, terms.select("term", "df"), missing=missing).withColumn("idf", idf)
    tf = F.log("tf") + 1.0 if sublinear_tf else F.col("tf").cast("double")
    raw = tf * F.col("idf")
    weighted = weighted.withColumn("x", raw)
    inside = [block] if block else []
    row = W.partitionBy(*inside, "id")
    if norm == "l2":
        length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(row))
    elif norm == "l1":
        length = F.sum(F.abs("x")).over(row)
    else:
        length = F.lit(1.0)
    weighted = weighted.withColumn("length", length)
    x = F.coalesce(raw / F.nullif(F.col("length"), F.lit(0.0)), F.lit(0.0)).alias("x")
    if not block:
        return weighted.select("id", "term", x)
    lone = [] if missing is None else [(F.col("df") == 1).alias("lone")]
    out = weighted.select(*inside, "id", "term", "tf", "idf", "length", *lone)
    with placed_by_block(counts.sparkSession):
        staged = stage_by_block(out, "tfidf", placed=True)
    return staged.select(*inside, "id", "term", x, *(["lone"] if lone else []))


def union_features(**blocks: DataFrame) -> DataFrame:
    """Put long feature blocks side by side: terms get their block's name as prefix."""
    parts = [
        df.select("id", F.concat(F.lit(f"{name}:"), "term").alias("term"), "x")
        for name, df in blocks.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of every column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.agg(*aggs)


def scale(
    df: DataFrame, cols: Sequence[str], identity: bool = False, eps: float = 1e-6,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """``(x - mean) / (std + eps)``; identity mode only divides by ``1 + eps``.

    The moments are one row, read into literals.
    """
    if identity:
        return df.withColumns({c: F.col(c).cast("double") / (1 + eps) for c in cols})
    m = (moments(df, cols) if fitted is None else fitted).first()
    return df.withColumns({
        c: (F.col(c).cast("double") - (m[f"{c}_mean"] or 0.0)) / ((m[f"{c}_std"] or 0.0) + eps)
        for c in cols
    })


def numeric_block(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns as a long feature block ``(id, term, x)`` without zeros."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("x")) for c in cols
    ])
    return df.select("id", F.inline(pairs)).filter(F.col("x") != 0)

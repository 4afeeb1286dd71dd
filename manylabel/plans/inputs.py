"""The driver tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manylabel.functions.fixed import MAX_TEXT, MIN_TEXT, PUNCTUATION
from manylabel.functions.labels import to_matrix
from manylabel.functions.lists import name_index
from manylabel.functions.text import clean_characters
from manylabel.operators.clean import clean_texts
from manylabel.operators.features import term_counts, tfidf
from manylabel.session import block_of, fit_width, stage_by_block, with_block

SOURCES = [f"src{i}" for i in range(20)]
Q = len(SOURCES)
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    fit_width(spark, path)
    return spark.read.parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, class_id, n_chars, lang, text)`` with the source as the weak class."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        name_index(F.col("source"), SOURCES).alias("class_id"),
        "n_chars", "lang", "text",
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their whole texts; only characters are cleaned."""
    return documents(spark, sf_dir).select(
        "id", "class_id", "n_chars", clean_characters(F.col("text")).alias("text")
    )


def cleaned_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts after the whole cleaning chain with its limits."""
    docs = clean_texts(
        documents(spark, sf_dir), lang="en", max_length=MAX_TEXT, n=MIN_TEXT, keep_ids=()
    )
    return docs.select("id", "class_id", "n_chars", "text")


class Corpus:
    """Staged ids, counts and TF-IDF rows of the cleaned documents.

    The raw text is read once and not staged. Every table is bucketed by blocks of ids, so the learners join and sum
    by document without moving them. ``labels`` are the positives by source.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, with_tfidf: bool = True):
        self.spark, self.sf_dir = spark, sf_dir
        docs = cleaned(spark, sf_dir)
        self.ids = stage_by_block(docs.select("id", "class_id"), "docs")
        counts = term_counts(with_block(docs, block_of(self.ids.columns)))
        self.counts = stage_by_block(counts, "counts", placed=True)
        self.labels = self.ids
        self.n = self.ids.count()
        self.features = None
        if with_tfidf:
            self.features = tfidf(self.counts, self.n)

    def quality(self) -> DataFrame:
        """Positives of one class: documents labelled as good."""
        good = table(self.spark, self.sf_dir, "labels").filter(F.col("quality") == 1)
        return self.ids.select("id").join(
            good.select(F.col("doc_id").alias("id")), "id", "left_semi"
        ).withColumn("class_id", F.lit(0))

    def targets(self) -> DataFrame:
        return to_matrix(self.labels, Q, self.ids)


def user_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, class_id, n)``: how often each user caused each type of event."""
    return table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("id"),
        name_index(F.col("event_type"), EVENT_TYPES).alias("class_id"),
    ).agg(F.count(F.lit(1)).alias("n"))


# --- the same roles in SQL --------------------------------------------------

_CHARS = PUNCTUATION.replace("'", "''")

DOCS = """
docs AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS class_id, n_chars, lang, text
  FROM documents)"""

CLEAN = f"""
clean AS MATERIALIZED (
  SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS class_id, n_chars,
         translate(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), '{_CHARS}', '') AS text
  FROM documents)"""

CLEAN_AND_CUT = f"""
squeezed AS (
  SELECT id, class_id, n_chars,
         regexp_replace(regexp_replace(x, ' +', ' ', 'g'), ' http[^\\n]*? ', ' ', 'g') AS t
  FROM (SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS class_id, n_chars,
               translate(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')),
                         '{_CHARS}', '') AS x
        FROM documents WHERE lang = 'en')
  WHERE length(x) - length(replace(x, ' ', '')) <= length(x) // 4),
clean AS MATERIALIZED (
  SELECT id, class_id, n_chars, text
  FROM (SELECT id, class_id, n_chars,
               CASE WHEN instr(substr(t, 3001), ' ') = 0 THEN t
                    ELSE substr(t, 1, 2999 + instr(substr(t, 3001), ' ')) END AS text
        FROM squeezed)
  WHERE length(text) >= {MIN_TEXT})"""

COUNTS = CLEAN + """,
counts AS MATERIALIZED (
  SELECT id, class_id, term, count(*) AS tf
  FROM (SELECT id, class_id,
               unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term
        FROM clean)
  GROUP BY ALL)"""

TFIDF = COUNTS + """,
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM counts GROUP BY term),
raw AS (
  SELECT id, class_id, term,
         tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM clean)) / (1 + df)) + 1) AS x
  FROM counts JOIN dfs USING (term)),
tfidf AS MATERIALIZED (
  SELECT id, class_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM raw)"""

USER_TYPES = """
user_types AS (
  SELECT user_id AS id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1
         WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS class_id,
         count(*) AS n
  FROM events GROUP BY ALL)"""

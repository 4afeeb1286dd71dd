"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept and returns the columns of its input,
but for the last, which returns the placement of the documents in bins. Rows with a null id or
text, repeated rows and additional columns pass through as each operator defines.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manylabel.llm import line_dedup, near_documents, packing, suffix_dedup, toxicity
from manylabel.plans.registry import query
from manylabel.session import drop_staged, stage, staging

#: A document is toxic from this score on.
TOXIC = 0.7
#: Bytes of a passage that counts as repeated across documents (some 25 words and more).
PASSAGE = 150


#: What the stage before has staged; its output is written when the next stage starts.
_left: list = []


def tidy(function):
    """Remove the staged tables of the stage before, unless ``docs`` still reads them."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        done = [x for x in _left if not any(x[0].rsplit("/", 1)[-1] in f for f in read)]
        drop_staged(spark, done)
        _left[:] = [x for x in _left if x not in done]
        with staging() as tables:
            out = function(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return run_stage


@tidy
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model, keep=tuple(docs.columns), score="toxic_score__")
    return scored.filter(F.col("toxic_score__") < TOXIC).drop("toxic_score__")


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as id, text and one struct of all other columns, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*others).alias("row"))


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the text that stays; documents that lost all of it go."""
    new, touched = F.col("kept_text"), F.col("n_removed") > 0
    columns = {"text": new, "n_chars": F.when(touched, F.length(new)).otherwise(F.col("row.n_chars")).cast("long")}
    return changed.filter(~(touched & (F.length(new) == 0))).select(
        *[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    )


@tidy
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of two lines or more, or of one long line."""
    changed = line_dedup.remove_repeated_lines(_whole(docs), keep=("row",), with_text=True, long_line=line_dedup.LONG_LINE)
    return _with_text(changed, docs)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; of rows of one id, one for each text."""
    groups = near_documents.near_documents(docs)
    kept = stage(groups.filter("key = component").select(F.col("key").alias("doc_id")).distinct(), "pipeline-kept")
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


@tidy
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start in an earlier document."""
    changed = suffix_dedup.remove_repeated_strings(_whole(docs), PASSAGE, keep=("row",), with_text=True)
    return _with_text(changed, docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words, at most two documents of a source in each."""
    return packing.pack_documents(docs, F.xxhash64("text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: Learned scores, suffix arrays and packing are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

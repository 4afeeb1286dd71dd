"""Language of a text from character trigrams, for tables without a language column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manylabel.functions.labels import to_matrix
from manylabel.functions.lists import index_name
from manylabel.operators import bayes
from manylabel.operators.features import term_counts
from manylabel.session import shuffle_width, stage, stage_by_block, with_block

# Every run of three characters, overlapping.
TRIGRAMS = r"(?s)(?=(.{3}))"


def trigram_counts(df: DataFrame, column: str = "text") -> DataFrame:
    return term_counts(df, column, pattern=TRIGRAMS, group=1)


def detect_language(
    texts: DataFrame | None, train: DataFrame, languages: Sequence[str], alpha: float = 1.0
) -> DataFrame:
    """``(id, lang)`` of ``texts(id, text)`` by naive Bayes on ``train(id, lang, text)``.

    Without ``texts``, they are those of ``train``, whose trigrams are then counted once. Texts without any trigram have no language, so they count as foreign.
    """
    index = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
    known = train.filter(F.col("lang").isin(*languages)).withColumn("class_id", index.cast("int"))
    y = stage(to_matrix(known, len(languages)), "targets")
    # A text has twice as many trigrams as words, so blocks are half as large.
    block = f"_block_{2 * shuffle_width(train.sparkSession)}"

    def staged(docs: DataFrame) -> DataFrame:
        return stage_by_block(trigram_counts(with_block(docs, block)), "trigrams", placed=True)

    counts = staged(train if texts is None else texts)
    model = bayes.fit_multiclass(counts if texts is None else staged(known), y, len(languages), alpha)
    texts = train if texts is None else texts
    scored = bayes.score(model, counts, counts.select("id").distinct())
    named = scored.select(
        "id", index_name(bayes.best_class("m"), languages).alias("lang")
    )
    return texts.select("id").join(named, "id", "left")


def keep_detected(
    texts: DataFrame, train: DataFrame, languages: Sequence[str], lang: str = "en"
) -> DataFrame:
    """Rows of ``texts`` whose detected language is ``lang``."""
    found = detect_language(texts, train, languages).filter(F.col("lang") == lang)
    return texts.join(found.select("id"), "id", "left_semi")

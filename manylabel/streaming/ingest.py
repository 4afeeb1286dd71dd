"""Continuous ingest of pages: parse, filter, conform, deduplicate, append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from manylabel.functions.fixed import APP_HEADER, CATEGORIES, TRIVIAL_FIELDS
from manylabel.operators.clean import allow_categories, complete, conform
from manylabel.sources.pages import APP_PAGE_RULES, Rule, extract_fields


def read_page_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Pages as they arrive in a folder of Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def dedup_stream(
    df: DataFrame, key: str, watermark: tuple[str, str] | None = None
) -> DataFrame:
    """Each key once. The state holds the seen keys and survives restarts.

    ``watermark = (time column, delay)`` bounds that state.
    """
    if watermark is None:
        return df.dropDuplicates([key])
    return df.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])


def pages_to_records(
    pages: DataFrame, rules: Mapping[str, Rule] = APP_PAGE_RULES, id_col: str = "Package",
    header: Sequence[str] = APP_HEADER, trivial: Sequence[str] = TRIVIAL_FIELDS,
    names: Sequence[str] | None = CATEGORIES, category: str = "Category",
    min_fields: int = 10, strict: bool = False,
) -> DataFrame:
    """The same record step for batches and streams; every part of it is row-wise."""
    parsed = extract_fields(pages, rules)
    if names is not None:
        parsed = parsed.filter(F.map_contains_key("fields", category))
    records = conform(parsed, "fields", id_col, header, trivial)
    if names is not None:
        records = allow_categories(records, category, names)
    return complete(records, min_fields, strict, header)


def ingest_stream(
    records: DataFrame, path: str, checkpoint: str, fmt: str = "csv", every: str | None = None
) -> StreamingQuery:
    """Append records to ``path``; without ``every`` it takes what is there and ends."""
    writer = records.writeStream.format(fmt).outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if fmt == "csv":
        writer = writer.option("escape", '"').option("header", "false")
    writer = (
        writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    )
    return writer.start(path)

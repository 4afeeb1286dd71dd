"""Dataset, label-matrix and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_dataset(df: DataFrame, path: str) -> None:
    """Features and labels, split in folders ``split=train`` and ``split=test``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Both parts, or one of them by partition pruning."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def load_ids(dataset: DataFrame) -> DataFrame:
    return dataset.select("id", "split")


def save_labels(df: DataFrame, path: str, model: str) -> None:
    """Positives of one model; saving a model again replaces only that model."""
    (
        df.select("id", "class_id").withColumn("model", F.lit(model))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("model").parquet(path)
    )


def load_labels(spark: SparkSession, path: str, models: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("model").isin(*models)) if models else df


def labels_json(matrix: DataFrame) -> DataFrame:
    """``(id, row)`` with the 0/1 array as JSON text."""
    return matrix.select("id", F.to_json("y").alias("row"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')

"""Session defaults and staging of intermediate tables.

Loops and multiply-used intermediates are cut with written Parquet tables in the
shared folder named by ``spark.checkpoint.dir``: they survive lost executors, are
columnar, and give Catalyst real sizes to choose join strategies from.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", app: str = "manylabel", **conf) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SHUFFLE = "spark.sql.shuffle.partitions"
#: The number that :func:`tune` or :func:`fit_width` set last, as a session setting.
TUNED = "spark.manylabel.partitions"
#: Bytes of an input's files for each shuffle partition; its features take some thirty times as much.
PARTITION_BYTES = 8 << 20


def _open(spark: SparkSession) -> bool:
    """Whether nobody but this module has chosen the number of shuffle partitions."""
    if spark.sparkContext.getConf().contains(SHUFFLE):
        return False
    return spark.conf.get(SHUFFLE) in ("200", spark.conf.get(TUNED, None))


def _set(spark: SparkSession, width: int) -> None:
    spark.conf.set(SHUFFLE, width)
    spark.conf.set(TUNED, str(width))


def tune(spark: SparkSession) -> None:
    """Use one shuffle partition per core where nobody has chosen a number.

    Spark's stock 200 is too few for a large cluster and too many for one machine.
    :func:`fit_width` raises the number for large inputs.
    """
    if _open(spark):
        _set(spark, spark.sparkContext.defaultParallelism)


def fit_width(spark: SparkSession, path: str) -> None:
    """Raise the number of shuffle partitions with the size of an input that is read.

    So what a task holds stays the same however large the input is.
    """
    if _open(spark):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        _set(spark, max(int(spark.conf.get(SHUFFLE)), -(-size // PARTITION_BYTES)))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of keyed and ordered tables."""
    return int(spark.conf.get(SHUFFLE))


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    It is the one named by ``spark.checkpoint.dir``, else the context's checkpoint folder,
    else a folder in the warehouse; all three are shared on a cluster.
    """
    return (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"
    )


_scopes: list[list[tuple[str, str | None]]] = []


@contextmanager
def staging() -> Iterator[list[tuple[str, str | None]]]:
    """Collect the path, and the catalog name if any, of everything staged inside."""
    made: list[tuple[str, str | None]] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def made(path: str, name: str | None = None) -> None:
    """Tell the innermost scope about a staged table."""
    if _scopes:
        _scopes[-1].append((path, name))


def drop_staged(spark: SparkSession, tables: list[tuple[str, str | None]]) -> None:
    """Remove staged tables that nothing reads any more."""
    for path, name in tables:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        remove(spark, path)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    made(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class LoopState:
    """The staged state of a loop; each new state removes the one before it."""

    def __init__(self, spark: SparkSession, label: str = "loop", compression: str = "snappy"):
        self.spark = spark
        self.label = label
        self.compression = compression
        self.path = None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{staging_root(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        made(self.path)
        df.write.parquet(self.path, compression=self.compression)
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table, on whichever file system the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Room for the different terms of a file, so that its rows hold numbers instead of them.
DICTIONARY_BYTES = 8 << 20


def stage_by_key(
    df: DataFrame, key: str = "id", label: str = "keyed", placed: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Like :func:`stage`, but bucketed by ``key``.

    Later joins and aggregates on ``key`` read this table without shuffling it; only the
    other side moves. ``placed`` says that ``df`` is hash-partitioned by ``key`` already;
    ``width`` is the number of buckets, else that of shuffle partitions.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    width = width or shuffle_width(spark)
    made(f"{staging_root(spark)}/{name}", name)
    (
        (df if placed else df.repartition(width, key))
        .write.bucketBy(width, key)
        .sortBy(key)
        .option("path", f"{staging_root(spark)}/{name}")
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .saveAsTable(name)
    )
    return spark.table(name)


#: Whether a join has to be placed by all of its keys; see :func:`placed_by_block`.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def block_of(columns: Sequence[str]) -> str | None:
    """The column that names a row's block, if there is one; it ends in the number of blocks."""
    return next((c for c in columns if re.fullmatch(r"_block_\d+", c)), None)


def block_width(block: str) -> int:
    return int(block.rsplit("_", 1)[1])


#: Names of the blocks, by their number.
_names: dict[int, list[int]] = {}


def with_block(df: DataFrame, block: str) -> DataFrame:
    """Add the block of each row, a function of its ``id``.

    Blocks are named so that each falls into a bucket of its own.
    """
    if block in df.columns:
        return df
    width = block_width(block)
    if width not in _names:
        drawn = df.sparkSession.range(64 * width).select(F.col("id").cast("int").alias("k"))
        found = drawn.groupBy(F.pmod(F.hash("k"), F.lit(width)).alias("p")).agg(F.min("k").alias("k"))
        held = {r["p"]: r["k"] for r in found.collect()}  # one row per block
        # A bucket that no number fell into, which is next to impossible, stays empty.
        _names[width] = [held.get(p, p) for p in range(width)]
    keys = F.array(*[F.lit(k).cast("int") for k in _names[width]])
    return df.withColumn(block, F.get(keys, F.pmod(F.xxhash64("id"), F.lit(width)).cast("int")))


def stage_by_block(df: DataFrame, label: str = "blocked", placed: bool = False) -> DataFrame:
    """Write ``df`` bucketed by blocks of its ids, with the block as a column.

    Numbers by term can be sent to the blocks that hold the term: joins on block and term leave this
    table where it is, and so do joins and sums on block and id.
    """
    block = block_of(df.columns) or f"_block_{shuffle_width(df.sparkSession)}"
    return stage_by_key(with_block(df, block), block, label, placed, block_width(block))


@contextmanager
def placed_by_block(spark: SparkSession) -> Iterator[None]:
    """Inside, joins on block and another key take tables that are placed by block as they are."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def at_ids(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` and the keys to join it with ``rows`` by id, so that ``rows`` stay in their blocks."""
    block = block_of(rows.columns)
    return (with_block(docs, block), [block, "id"]) if block else (docs, ["id"])

"""Scans. Schemas are given, so no scan reads data to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from primrose.schemas import ANNOTATION_RESULT, ARTICLES, CAPTURE, FEED_ITEM, MESSAGES


def spread_small(df: DataFrame, key: str, fan_out: int = 8) -> DataFrame:
    """Spread a small table over the cores; leave a large one as it lies.

    A file written as one row group is one task, whatever the cluster. While
    the scan has fewer splits than there are cores it cannot occupy them, and
    moving it once by ``key`` is cheap (its size is below cores x split size).
    From there on its own splits give enough tasks, and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(min(cores, splits * fan_out), key) if splits < cores else df


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLES).parquet(path)


def scan_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path)


def scan_message_json(
    spark: SparkSession, path: str, pattern: str = "*.json"
) -> DataFrame:
    """Every ``.json`` file under a folder, each a JSON array of messages.

    Deviation: all files are read, where the original keeps the last one. A
    file is one task, so capture files are kept small (see
    :func:`~primrose.sources.sinks.write_capture_files`).
    """
    return (
        spark.read.schema(CAPTURE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(path)
    )


def scan_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """``item`` elements of feed files: ``link`` and all ``rating`` tags,
    whatever their prefix."""
    return (
        spark.read.schema(FEED_ITEM)
        .format("xml")
        .option("rowTag", "item")
        .option("ignoreNamespace", True)
        .load(path)
    )


def scan_annotation_batches(spark: SparkSession, path: str) -> DataFrame:
    """All result files of a folder with ``file`` and the place of the row.

    ``row_no`` rises in reading order inside a file; it has gaps.
    """
    return (
        spark.read.schema(ANNOTATION_RESULT)
        .option("header", True)
        .csv(path)
        .withColumns(
            {
                "file": F.col("_metadata.file_name"),
                "row_no": F.col("_metadata.file_block_start")
                + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
    )


def scan_id_grid(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """Header-less grid of ids, one id per row; short rows are allowed."""
    schema = T.StructType(
        [T.StructField(f"c{i}", T.StringType()) for i in range(columns)]
    )
    cells = F.array(*[F.col(f.name) for f in schema.fields])
    return (
        spark.read.schema(schema)
        .csv(path)
        .select(F.explode(cells).alias("id"))
        .filter(F.col("id").isNotNull())
    )


def scan_latest_snapshot(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Saved positions of one part from the newest snapshot.

    Part and time are partition columns. To find the newest time the footers
    of this part's files are opened, without a data column; then only the files
    of that time are read.
    """
    saved = spark.read.parquet(path).filter(F.col("part") == part)
    newest = saved.agg(F.max("snapshot_ts").alias("ts"))
    return saved.filter(F.col("snapshot_ts") == newest.scalar())

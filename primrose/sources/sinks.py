"""Sinks. Every writer is a distributed write; nothing passes the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from primrose.operators.feeds import new_items
from primrose.operators.messages import CHUNK_BYTES, size_chunks
from primrose.operators.rank import dist_rank
from primrose.schemas import ARTICLES, MESSAGES, conform


def write_messages_json(df: DataFrame, path: str) -> None:
    """Captured messages as JSON lines."""
    df.write.mode("errorifexists").json(path)


def write_capture_files(
    df: DataFrame, path: str, order: Sequence[str], rows_per_file: int = 1000
) -> None:
    """Captured messages as JSON array files of at most ``rows_per_file``.

    ``order`` ends in a unique key; only the order columns are ranked.
    """
    ranks = dist_rank(df.select(*order), order).select(order[-1], "rank")
    numbered = df.join(ranks, order[-1]).withColumn(
        "file_no", F.floor((F.col("rank") - 1) / rows_per_file).cast("long")
    )
    record = F.struct("rank", "text", "possibly_sensitive", "source", "lang")
    arrays = numbered.groupBy("file_no").agg(
        F.to_json(
            F.transform(
                F.sort_array(F.collect_list(record)), lambda r: r.dropFields("rank")
            )
        ).alias("value")
    )
    arrays.repartition("file_no").write.partitionBy("file_no").text(path)


def write_chunked_json(
    df: DataFrame,
    path: str,
    key: str,
    limit: int = CHUNK_BYTES,
    filename: str = "filename",
    text: str = "page_text",
) -> None:
    """Crawl output rolled at ``limit`` bytes of text per input file; folder
    names carry the input name and the chunk number.

    Chunk numbers are computed on keys and sizes only and joined back.
    """
    sizes = df.select(key, filename, F.octet_length(F.coalesce(text, F.lit(""))).alias("size"))
    chunks = size_chunks(sizes, [key], limit, filename).select(key, "chunk")
    (
        df.join(chunks, key)
        .repartition(filename, "chunk")
        .sortWithinPartitions(filename, "chunk", key)
        .write.partitionBy(filename, "chunk")
        .json(path)
    )


def _bad_message(df: DataFrame) -> Column:
    flag = F.col("possibly_sensitive").cast("string").try_cast("boolean")
    return (
        F.col("text").isNull()
        | F.col("link").isNull()
        | (F.col("possibly_sensitive").isNotNull() & flag.isNull())
    )


def split_bad_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and those that cannot."""
    tagged = df.withColumn("__bad", F.coalesce(_bad_message(df), F.lit(False)))
    good = tagged.filter(~F.col("__bad")).drop("__bad")
    return good, tagged.filter("__bad").drop("__bad")


def append_messages(df: DataFrame, table: str) -> None:
    """Append one row per (message, link) as pending; rows that cannot be
    stored go to ``<table>_rejects`` and stop nothing."""
    good, bad = split_bad_messages(df)
    flag = F.col("possibly_sensitive").cast("string").try_cast("boolean")
    pending = good.withColumn("possibly_sensitive", flag).withColumn("crawled", F.lit(False))
    conform(pending, MESSAGES).write.mode("append").parquet(table)
    bad.write.mode("append").json(f"{table}_rejects")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def insert_new_articles(df: DataFrame, table: str) -> None:
    """Append the articles whose id the table does not hold yet."""
    spark = df.sparkSession
    rows = conform(df, ARTICLES)
    if _exists(spark, table):
        rows = new_items(rows, spark.read.schema(ARTICLES).parquet(table))
    rows.write.mode("append").parquet(table)


def write_table_version(df: DataFrame, table: str, version: int) -> str:
    """A keyed update writes a new version folder and never the one it reads."""
    path = f"{table}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_annotation_csv(df: DataFrame, path: str) -> None:
    df.select("site1", "site2", "site3").write.option("header", True).csv(path)


def write_link_flags_csv(df: DataFrame, path: str) -> None:
    """``link,flag`` with ``|`` as quote character, quoted only where needed."""
    df.select("link", "flag").write.option("header", True).option("quote", "|").csv(path)


def write_split_snapshot(df: DataFrame, path: str, ts: str) -> None:
    """Positions by part and time; ``ts`` is ``yyyy-MM-dd HH:mm:ss``."""
    (
        df.withColumn("snapshot_ts", F.lit(ts).cast("timestamp"))
        .write.mode("append")
        .partitionBy("part", "snapshot_ts")
        .parquet(path)
    )


def write_probabilities(df: DataFrame, path: str) -> None:
    """Row key and the two class probabilities, as columns ``0`` and ``1``."""
    df.select(
        F.col("doc_id"), F.col("p0").alias("0"), F.col("p1").alias("1")
    ).write.option("header", True).csv(path)

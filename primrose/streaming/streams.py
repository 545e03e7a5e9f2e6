"""Streams over file sources.

Each function starts a query that drains what is there and stops
(``availableNow``); started again on the same checkpoint it goes on with new
files. ``foreachBatch`` may repeat a batch after a failure, so every batch
writes to a folder of its own number in overwrite mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from primrose.operators.feeds import first_feed_wins, new_items
from primrose.operators.messages import (
    bounded_capture,
    crawl_results,
    explode_links,
    filter_messages,
    project_messages,
)
from primrose.operators.ratings import RATING_ORDER, fill_rating_slots
from primrose.schemas import RATING_SLOTS
from primrose.sources.sinks import _exists

RESULT_COLS = ("page_text", "errors", "link_actual")


def stream_capture(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Unbounded messages through the capture rules to parquet files."""
    return (
        project_messages(filter_messages(messages))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """Everything the batches before ``before`` wrote."""
    if not _exists(spark, out):
        return None
    return spark.read.parquet(out).filter(F.col("batch") < before)


def stream_bounded(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    cap: int,
    order: Sequence[str],
) -> StreamingQuery:
    """As :func:`stream_capture`, up to ``cap`` messages.

    A batch takes what the earlier batches left over of the cap; only their
    row count is read. Once the cap is reached, batches are neither read nor
    written.
    """

    def take(batch: DataFrame, number: int) -> None:
        earlier = _batches(batch.sparkSession, out, number)
        left = cap - (earlier.count() if earlier is not None else 0)
        if earlier is not None and left <= 0:
            return
        kept = bounded_capture(filter_messages(batch), max(left, 0), order)
        project_messages(kept).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        messages.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_links(
    messages: DataFrame, pages: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Messages to links to stored crawl results, batch by batch.

    ``messages`` has ``id`` and ``text``. The checkpoint stands in for the
    polled ``crawled`` mark: each message is handled in one batch.
    """

    def crawl(batch: DataFrame, number: int) -> None:
        done = crawl_results(batch, pages).withColumn("crawled", F.lit(True))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        explode_links(messages)
        .writeStream.foreachBatch(crawl)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_new_articles(
    items: DataFrame, stored: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Feed items whose id is neither stored nor written by earlier batches."""

    def insert(batch: DataFrame, number: int) -> None:
        fresh = new_items(first_feed_wins(batch), stored)
        earlier = _batches(batch.sparkSession, out, number)
        if earlier is not None:
            fresh = new_items(fresh, earlier)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        items.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ratings(
    ratings: DataFrame,
    articles: str,
    checkpoint: str,
    order: Sequence[str] = RATING_ORDER,
) -> StreamingQuery:
    """Rating files as they arrive, each put into the empty slots once.

    ``articles`` is a folder of versions ``version=<n>``; batch ``b`` reads
    version ``b`` and writes version ``b + 1``, so a repeated batch gives the
    same table.
    """

    def fill(batch: DataFrame, number: int) -> None:
        current = batch.sparkSession.read.parquet(f"{articles}/version={number}")
        fill_rating_slots(current, batch, order).write.mode("overwrite").parquet(
            f"{articles}/version={number + 1}"
        )

    return (
        ratings.writeStream.foreachBatch(fill)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_appends(messages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """One pending row for each (message, link), appended to ``<table>/rows``.

    ``row_id`` is the key of a row: repeated messages and repeated links are
    rows of their own. The file sink commits each batch once, so a repeated
    batch leaves neither rows nor ids twice.
    """
    return (
        explode_links(messages)
        .withColumn("row_id", F.expr("uuid()"))
        .writeStream.format("parquet")
        .option("path", f"{table}/rows")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_crawl(
    spark: SparkSession, pages: DataFrame, table: str, checkpoint: str
) -> StreamingQuery:
    """Results of the rows appended since the last run, as updates by ``row_id``.

    The checkpoint says which rows are still pending, so a run reads new rows
    and ``pages`` only and writes to ``<table>/results`` only what it found:
    rows already stored are neither read nor written again.
    """
    pending = (
        spark.readStream.schema("row_id string, link string")
        .parquet(f"{table}/rows")
    )
    return (
        crawl_results(pending, pages)
        .select("row_id", *RESULT_COLS)
        .writeStream.format("parquet")
        .option("path", f"{table}/results")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_message_table(spark: SparkSession, table: str) -> DataFrame:
    """The rows of :func:`stream_appends` with the updates of
    :func:`stream_crawl`: ``crawled`` is true where there is one, the result
    columns are null where not. A table that nothing was appended to is an
    error."""
    rows = spark.read.parquet(f"{table}/rows")
    rows = rows.drop("crawled", *RESULT_COLS)
    if not _exists(spark, f"{table}/results"):
        nothing = [F.lit(None).cast("string").alias(c) for c in RESULT_COLS]
        return rows.select("*", F.lit(False).alias("crawled"), *nothing)
    results = spark.read.schema(
        "row_id string, " + ", ".join(f"{c} string" for c in RESULT_COLS)
    ).parquet(f"{table}/results")
    done = results.withColumn("crawled", F.lit(True))
    return (
        rows.join(done, "row_id", "left")
        .withColumn("crawled", F.coalesce("crawled", F.lit(False)))
    )


def rated_articles(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """``articles`` with the slots of the newest change of each; ``changes``
    has ``id``, ``batch`` and the slots. Article ids are unique."""
    slots = F.struct(*RATING_SLOTS)
    newest = changes.groupBy("id").agg(F.max_by(slots, "batch").alias("__new"))
    return (
        articles.join(newest, "id", "left")
        .withColumns(
            {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c))
             for c in RATING_SLOTS}
        )
        .select(*articles.columns)
    )


def stream_rating_changes(
    ratings: DataFrame,
    articles: DataFrame,
    changes: str,
    checkpoint: str,
    order: Sequence[str] = RATING_ORDER,
) -> StreamingQuery:
    """As :func:`stream_ratings`, where a batch writes the slots of the
    articles it changes, to ``<changes>/batch=<n>``, and no other.

    A batch reads ``articles`` (id and slots) and the changes of earlier
    batches, for its own articles alone; a repeated batch writes the same
    folder. :func:`rated_articles` gives the whole table. To fold the changes
    in, write that table between two runs and go on with it, an empty
    ``changes`` folder and the same checkpoint. Ratings of unknown articles
    change nothing.
    """

    def fill(batch: DataFrame, number: int) -> None:
        touched = batch.select(F.col("link_id").alias("id")).distinct()
        current = articles.select("id", *RATING_SLOTS).join(touched, "id", "left_semi")
        earlier = _batches(batch.sparkSession, changes, number)
        if earlier is not None:
            current = rated_articles(current, earlier.join(touched, "id", "left_semi"))
        before = current.withColumn("__before", F.struct(*RATING_SLOTS))
        filled = fill_rating_slots(before, batch, order)
        changed = filled.filter(~F.struct(*RATING_SLOTS).eqNullSafe(F.col("__before")))
        changed.drop("__before").write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return (
        ratings.writeStream.foreachBatch(fill)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

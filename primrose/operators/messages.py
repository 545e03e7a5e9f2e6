"""Messages: capture rules, links, crawl results, size accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.functions.links import extract_links
from primrose.operators.rank import dist_rank, dist_running_sum

# Markers and limits the stored results depend on.
FETCH_ERROR = "error visiting"
NO_VALUE = "None"
COMMIT_BATCH = 100
CHUNK_BYTES = 10_485_760
BYTES_PER_MB = 1_048_576


def filter_messages(df: DataFrame) -> DataFrame:
    """English messages that carry a sensitivity mark."""
    return df.filter(F.col("possibly_sensitive").isNotNull() & (F.col("lang") == "en"))


def filter_raw_messages(df: DataFrame, raw: str = "value") -> DataFrame:
    """The same rule on raw JSON text, where the key need only be present (an
    explicit null passes)."""
    return df.filter(
        F.array_contains(F.json_object_keys(raw), "possibly_sensitive")
        & (F.get_json_object(raw, "$.lang") == "en")
    )


def project_messages(df: DataFrame) -> DataFrame:
    return df.select("text", "possibly_sensitive", "source", "lang")


def bounded_capture(df: DataFrame, cap: int, order: Sequence[str]) -> DataFrame:
    """The first ``cap`` messages in ``order``: the size cap of a capture."""
    return df.orderBy(*order).limit(cap)


def explode_links(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per (message, link): columns ``pos`` and ``link`` are added. A
    message without links gives no row; repeated links are kept."""
    return df.select("*", F.posexplode(extract_links(F.col(text))).alias("pos", "link"))


def pending_links(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("crawled")).select("id", "link")


def pending_count(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("crawled")).agg(F.count("id").alias("pending"))


def next_pending(df: DataFrame, n: int = COMMIT_BATCH) -> DataFrame:
    """The next ``n`` pending links by id."""
    return pending_links(df).orderBy("id").limit(n)


def commit_batches(df: DataFrame, size: int = COMMIT_BATCH) -> DataFrame:
    """All pending links with the number of the batch that commits them."""
    ranked = dist_rank(pending_links(df), ["id"])
    return ranked.withColumn(
        "batch", F.floor((F.col("rank") - 1) / size).cast("long")
    ).drop("rank")


def last_in_batch(batches: DataFrame) -> DataFrame:
    return batches.groupBy("batch").agg(F.max("id").alias("last_id"))


def attach_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Fetched page of each link; ``fetched`` is false where there is none.

    ``pages`` has one row per ``link`` with ``link_actual`` and ``page_text``.
    A much repeated link skews only the left side, which AQE splits.
    """
    return links.join(
        pages.withColumn("__hit", F.lit(True)), "link", "left"
    ).select(
        *links.columns,
        "link_actual",
        "page_text",
        F.coalesce("__hit", F.lit(False)).alias("fetched"),
    )


def attach_crawled(messages: DataFrame, pages: DataFrame) -> DataFrame:
    """One independent row per (message, fetched link); failed fetches go.

    Deviation: the original shares one record between the links of a message,
    so that all its rows show the last link.
    """
    links = explode_links(messages).withColumnRenamed("link", "link_followed")
    found = links.join(
        pages.withColumnRenamed("link", "link_followed"), "link_followed", "inner"
    )
    return found.withColumn("errors", F.lit(""))


def blank_template_text(df: DataFrame, text: str = "page_text") -> DataFrame:
    """Text holding a template character becomes null."""
    return df.withColumn(text, F.when(~F.col(text).rlike(r"[_{}]"), F.col(text)))


def crawl_outcome(df: DataFrame) -> DataFrame:
    """What is stored for a link: ``page_text``, ``errors``, ``link_actual``."""
    text = F.coalesce(F.nullif(F.col("page_text"), F.lit("")), F.lit(NO_VALUE))
    outcome = {
        "page_text": F.when(F.col("fetched"), text).otherwise(NO_VALUE),
        "errors": F.when(F.col("fetched"), NO_VALUE).otherwise(FETCH_ERROR),
        "link_actual": F.when(F.col("fetched"), F.col("link_actual")).otherwise(NO_VALUE),
    }
    return df.withColumns(outcome).drop("fetched")


def crawl_results(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages looked up, template text blanked, outcome filled in."""
    return crawl_outcome(blank_template_text(attach_pages(links, pages)))


def merge_crawl_results(messages: DataFrame, results: DataFrame) -> DataFrame:
    """The new version of the message table: rows with a result are updated
    and marked as crawled, the others stay as they are."""
    new = results.select(
        "id",
        *[F.col(c).alias(f"__{c}") for c in ("page_text", "errors", "link_actual")],
        F.lit(True).alias("__done"),
    )
    merged = messages.join(new, "id", "left")
    updated = {
        c: F.when(F.col("__done"), F.col(f"__{c}")).otherwise(F.col(c))
        for c in ("page_text", "errors", "link_actual")
    }
    updated["crawled"] = F.coalesce("__done", "crawled")
    return merged.withColumns(updated).select(*messages.columns)


def size_chunks(
    df: DataFrame,
    order: Sequence[str],
    limit: int = CHUNK_BYTES,
    filename: str = "filename",
    size: str = "size",
) -> DataFrame:
    """Running bytes per file and the output chunk each row falls into.

    Chunk borders lie at multiples of ``limit`` of the running size before the
    row, where the original restarts its count after each roll.
    """
    running = dist_running_sum(df, [filename], order, {"running": size})
    before = F.col("running") - F.col(size)
    return running.withColumn("chunk", F.floor(before / limit).cast("long"))


def progress_marks(
    df: DataFrame, order: Sequence[str], every: int = 100, size: str = "size"
) -> DataFrame:
    """Rows and megabytes so far, at every ``every``-th row."""
    running = dist_running_sum(
        df, [], order, {"rows_so_far": F.lit(1), "bytes_so_far": size}
    )
    return running.filter(F.col("rows_so_far") % every == 0).select(
        "rows_so_far",
        F.round(F.col("bytes_so_far") / BYTES_PER_MB, 6).alias("mb_so_far"),
    )

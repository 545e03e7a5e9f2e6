"""Feeds and messages into their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.functions.text import html_to_text
from primrose.operators import feeds, messages


def new_articles(items: DataFrame, stored: DataFrame, replies: DataFrame) -> DataFrame:
    """Feed items that are not stored, with the parser's reply, ready to insert.

    ``items``: link, rating, feed_ord, item_ord; ``replies``: link, reply. Items
    known to the store are left out before the (wide) replies are joined.
    """
    flagged = feeds.key_items(feeds.adult_flag(items)).drop("rating")
    fresh = feeds.new_items(feeds.first_feed_wins(flagged), stored)
    parsed = feeds.parse_reply(feeds.key_items(replies)).drop("link")
    merged = feeds.merge_api_record(fresh, parsed)
    with_text = merged.withColumn("reporter_content", html_to_text(F.col("content")))
    return feeds.fill_none(with_text).select(
        "id", "link", "title",
        F.col("content").alias("parser_content"),
        "reporter_content",
        F.col("flag").alias("sensitive_flag"),
    )


def pending_messages(captured: DataFrame) -> DataFrame:
    """Captured messages as one pending row per link."""
    kept = messages.filter_messages(captured)
    return messages.explode_links(kept).withColumn("crawled", F.lit(False))


def crawled_messages(table: DataFrame, pages: DataFrame) -> DataFrame:
    """The next version of the message table: pending links looked up."""
    results = messages.crawl_results(messages.pending_links(table), pages)
    return messages.merge_crawl_results(table, results)

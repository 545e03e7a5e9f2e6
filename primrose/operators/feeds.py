"""Feed items: flags, status against the store, merging of API replies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.functions.links import link_key
from primrose.schemas import REPLY


def adult_flag(items: DataFrame, rating: str = "rating") -> DataFrame:
    """``flag`` is 1 when any rating tag reads ``adult``."""
    hit = F.exists(rating, lambda r: r == "adult")
    return items.withColumn("flag", F.coalesce(hit, F.lit(False)).cast("int"))


def key_items(items: DataFrame) -> DataFrame:
    """Items with the ``id`` of their link."""
    return items.withColumn("id", link_key(F.col("link")))


def union_feeds(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """All feeds as one frame; ``feed_ord`` is the order they are stored in."""
    out = None
    for order, (name, items) in enumerate(feeds.items()):
        tagged = items.withColumns({"feed": F.lit(name), "feed_ord": F.lit(order)})
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no feeds")
    return out


def first_feed_wins(
    items: DataFrame, key: str = "id", feed_ord: str = "feed_ord", item_ord: str = "item_ord"
) -> DataFrame:
    """One row per item: the first feed it occurs in, there its last entry.

    An aggregate, not a window: partial results collapse a much repeated item
    before the exchange.
    """
    rest = [c for c in items.columns if c not in (key, feed_ord, item_ord)]
    best = F.min_by(
        F.struct(feed_ord, item_ord, *rest),
        F.struct(F.col(feed_ord), -F.col(item_ord)),
    )
    picked = items.groupBy(key).agg(best.alias("__best"))
    return picked.select(key, "__best.*")


def stored_status(items: DataFrame, articles: DataFrame) -> DataFrame:
    """``in_db`` is true when exactly one stored article has the item's id; a
    doubly stored id counts as not stored."""
    stored = articles.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    return (
        items.join(stored, "id", "left")
        .withColumn("in_db", F.coalesce(F.col("__n") == 1, F.lit(False)))
        .drop("__n")
    )


def new_items(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items whose id is not stored."""
    return items.join(articles.select("id"), "id", "left_anti")


def parse_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """API reply text to nullable ``title`` and ``content``."""
    parsed = F.from_json(reply, REPLY)
    return df.withColumns(
        {f.name: parsed.getField(f.name) for f in REPLY.fields}
    ).drop(reply)


def merge_api_record(items: DataFrame, replies: DataFrame, key: str = "id") -> DataFrame:
    """Reply fields overwrite item fields of the same name.

    Deviation: a null or missing reply field does not overwrite.
    """
    fields = [c for c in replies.columns if c != key]
    renamed = replies.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = items.join(renamed, key, "left")
    merged = {
        c: F.coalesce(f"__{c}", c) if c in items.columns else F.col(f"__{c}")
        for c in fields
    }
    return joined.withColumns(merged).drop(*[f"__{c}" for c in fields])


def fill_none(df: DataFrame) -> DataFrame:
    """Missing title to ``'None'``; missing content sets both content columns
    to ``'None'``."""
    missing = F.col("content").isNull()
    return df.withColumns(
        {
            "title": F.coalesce("title", F.lit("None")),
            "reporter_content": F.when(missing, "None").otherwise(F.col("reporter_content")),
            "content": F.coalesce("content", F.lit("None")),
        }
    )

"""Annotation batches: who is asked about what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.functions.links import compose_link_id
from primrose.functions.text import html_to_text, let, word_count
from primrose.operators.rank import dist_rank, dist_running_sum

SITES = ("site1", "site2", "site3")


def add_content_columns(df: DataFrame) -> DataFrame:
    """Plain text of the parsed page and its length in words.

    Generated rather than projected: a later filter on either column would
    otherwise be pushed below and clean every page a second time.
    """
    both = let(
        html_to_text(F.col("parser_content")),
        lambda text: F.struct(text.alias("content"), word_count(text).alias("content_len")),
    )
    return df.select("*", F.inline(F.array(both)))


def long_enough(df: DataFrame, n: int = 100) -> DataFrame:
    return df.filter(F.col("content_len") >= n)


def only_known_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id, as text, is among the submitted ids."""
    known = ids.select(F.col("id").cast("string").alias("__key")).distinct()
    return df.join(known, F.col("id").cast("string") == F.col("__key"), "left_semi")


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select("id").distinct()


def batch_slots(df: DataFrame, size: int = 3) -> DataFrame:
    """Rows by id in groups of ``size``: columns ``batch`` and ``pos``.

    ``df`` is narrow: ``id`` and ``link``.
    """
    ranked = dist_rank(df, ["id"])
    zero = F.col("rank") - 1
    return ranked.withColumns(
        {"batch": F.floor(zero / size).cast("long"), "pos": (zero % size).cast("int")}
    ).drop("rank")


def shuffle_in_batch(batches: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded order of the (three) links inside each batch, as ``pos``."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}")))
    w = W.partitionBy("batch").orderBy(key, "id")
    return batches.withColumn("pos", F.row_number().over(w) - 1)


def batch_grid(batches: DataFrame, drop_last: bool = True) -> DataFrame:
    """One row per batch with its links.

    ``drop_last`` keeps the original's rule: a batch is written only when one
    more link arrives, so the last batch, even a full one, is left out.
    """
    grid = batches.groupBy("batch").agg(
        *[
            F.max(F.when(F.col("pos") == i, F.col("link"))).alias(name)
            for i, name in enumerate(SITES)
        ]
    )
    if not drop_last:
        return grid
    last = batches.agg(F.max("batch").alias("last"))
    return grid.filter(F.col("batch") < last.scalar())


def annotation_batches(df: DataFrame, drop_last: bool = True) -> DataFrame:
    """Composite links of ``df`` (``id``, ``link``) in rows of three."""
    composed = df.select(
        "id", compose_link_id(F.col("link"), F.col("id")).alias("link")
    )
    return batch_grid(batch_slots(composed), drop_last)


def partial_label_counts(links: DataFrame) -> DataFrame:
    """Times each link id was labelled, with the last link text seen.

    ``links``: ``link_id``, ``link`` and the reading order ``ord``.
    """
    return links.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("times"),
        F.max_by("link", "ord").alias("link"),
    )


def partial_batches(counts: DataFrame, drop_last: bool = True) -> DataFrame:
    """New rows of three per number of labels, links by id.

    The rank inside a number of labels is a two-step running count: most links
    may share one number.
    """
    ranked = dist_running_sum(
        counts.select("times", "link_id", "link"), ["times"], ["link_id"],
        {"rank": F.lit(1)},
    )
    zero = F.col("rank") - 1
    placed = ranked.withColumns(
        {"batch": F.floor(zero / 3).cast("long"), "pos": (zero % 3).cast("int")}
    )
    grid = placed.groupBy("times", "batch").agg(
        *[
            F.max(F.when(F.col("pos") == i, F.col("link"))).alias(name)
            for i, name in enumerate(SITES)
        ]
    )
    if not drop_last:
        return grid
    # One row per number of labels.
    ends = placed.groupBy(F.col("times").alias("__times")).agg(F.max("batch").alias("__end"))
    return (
        grid.join(ends, F.col("times") == F.col("__times"))
        .filter(F.col("batch") < F.col("__end"))
        .drop("__times", "__end")
    )

"""Ratings: unpivot, slot filling, per-row and overall statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.functions.links import split_link, split_link_key
from primrose.functions.ratings import (
    count_ratings_expr,
    mean_rating_expr,
    rating_bin,
    sensitive_label,
)
from primrose.operators.rank import dist_running_sum
from primrose.schemas import RATING_SLOTS

RATING_ORDER = ("file", "row_no", "pos")


def unpivot_ratings(
    df: DataFrame,
    sites: Sequence[str] = ("Input.site1", "Input.site2", "Input.site3"),
    answers: Sequence[str] = ("Answer.Q1", "Answer.Q2", "Answer.Q3"),
    keep: Sequence[str] = ("file", "row_no"),
) -> DataFrame:
    """One row per (site, answer) pair; ``pos`` is the place in the row."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.col(f"`{s}`").alias("site"),
                F.col(f"`{a}`").alias("rating"),
            )
            for i, (s, a) in enumerate(zip(sites, answers, strict=True))
        ]
    )
    return df.select(*keep, F.inline(pairs))


def parse_ratings(pairs: DataFrame) -> DataFrame:
    """Composite site text to ``link`` and numeric ``link_id``."""
    site = F.col("site")
    return pairs.withColumns(
        {
            "link": split_link(site),
            "link_id": split_link_key(site).try_cast("long"),
        }
    ).drop("site")


def match_ratings(ratings: DataFrame, articles: DataFrame) -> DataFrame:
    """Each rating with the current slots of its article; see
    :func:`unmatched_ratings` for the rest."""
    slots = articles.select(F.col("id").alias("link_id"), *RATING_SLOTS)
    return ratings.join(slots, "link_id", "inner")


def unmatched_ratings(ratings: DataFrame, articles: DataFrame) -> DataFrame:
    """Ratings whose article is unknown (the original stops on these)."""
    known = articles.select(F.col("id").alias("link_id"))
    return ratings.join(known, "link_id", "left_anti")


def _first_ratings(ratings: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first five ratings per article that are not blank, numbered from 1.

    A blank or null rating leaves its slot empty, so it takes no number. An
    article has five slots, so later ratings can never be stored. Spark
    applies the limit before the exchange as well (window group limit): an
    article with any number of ratings sends five rows per task.
    """
    w = W.partitionBy("link_id").orderBy(*order)
    given = ratings.filter(F.coalesce(F.trim("rating"), F.lit("")) != "")
    return given.withColumn("k", F.row_number().over(w)).filter(
        F.col("k") <= len(RATING_SLOTS)
    )


def _empty_slots() -> Column:
    """Numbers of the empty slots of a row, in order."""
    flags = F.array(*[F.coalesce(F.col(c) == "", F.lit(False)) for c in RATING_SLOTS])
    return F.filter(
        F.sequence(F.lit(0), F.lit(len(RATING_SLOTS) - 1)), lambda i: F.get(flags, i)
    )


def assign_slots(
    articles: DataFrame, ratings: DataFrame, order: Sequence[str] = RATING_ORDER
) -> DataFrame:
    """Stored ratings: the k-th rating of an article takes its k-th empty slot;
    ratings beyond the empty slots are not stored."""
    free = articles.select(F.col("id").alias("link_id"), _empty_slots().alias("free"))
    return (
        _first_ratings(ratings, order)
        .join(free, "link_id", "inner")
        .withColumn("slot", F.get("free", F.col("k") - 1))
        .filter(F.col("slot").isNotNull())
        .drop("free", "k")
    )


def rating_audit_log(assigned: DataFrame) -> DataFrame:
    """One line per stored rating."""
    return assigned.select(
        F.col("file").alias("filename"),
        "link_id",
        "rating",
        F.concat(F.lit("turk_rating"), F.col("slot").cast("string")).alias("column"),
    )


def fill_rating_slots(
    articles: DataFrame, ratings: DataFrame, order: Sequence[str] = RATING_ORDER
) -> DataFrame:
    """Articles with the incoming ratings put into their empty slots.

    The five ratings kept per article are pivoted where the window already
    placed them, so the only further exchange is the join with the articles.
    """
    incoming = (
        _first_ratings(ratings, order)
        .groupBy("link_id")
        .agg(
            *[
                F.max(F.when(F.col("k") == k, F.col("rating"))).alias(f"__r{k}")
                for k in range(1, len(RATING_SLOTS) + 1)
            ]
        )
        .withColumnRenamed("link_id", "id")
    )
    queue = F.array(*[F.col(f"__r{k}") for k in range(1, len(RATING_SLOTS) + 1)])
    empty = [F.coalesce(F.col(c) == "", F.lit(False)).cast("int") for c in RATING_SLOTS]
    filled = []
    for i, slot in enumerate(RATING_SLOTS):
        taken = F.lit(0)
        for earlier in empty[:i]:
            taken = taken + earlier
        value = F.when(
            F.col(slot) == "", F.coalesce(F.get(queue, taken), F.lit(""))
        ).otherwise(F.col(slot))
        filled.append(value.alias(slot))
    # Generated, so that filters on rating columns read the five results
    # instead of having these expressions copied into them.
    rest = [c for c in articles.columns if c not in RATING_SLOTS]
    return (
        articles.join(incoming, "id", "left")
        .select(*rest, F.inline(F.array(F.struct(*filled))))
        .select(*articles.columns)
    )


def count_ratings(df: DataFrame) -> DataFrame:
    return df.withColumn("count_turk_ratings", count_ratings_expr())


def mean_rating(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_turk_ratings", mean_rating_expr())


def add_rating_columns(df: DataFrame) -> DataFrame:
    """Count, mean and label of the ratings of each row.

    Generated rather than projected, so that a filter on one of them does not
    parse the ratings again.
    """
    figures = F.struct(
        count_ratings_expr().alias("count_turk_ratings"),
        mean_rating_expr().alias("avg_turk_ratings"),
    )
    return df.select("*", F.inline(F.array(figures))).withColumn(
        "turk_sensitive_flag", sensitive_label(F.col("avg_turk_ratings"))
    )


def total_ratings(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(count_ratings_expr()).alias("total_ratings"))


def min_ratings(df: DataFrame, n: int = 3) -> DataFrame:
    return df.filter(F.col("count_turk_ratings") >= n)


def agreed_sensitive(df: DataFrame) -> DataFrame:
    """Average above one half (strictly) with at least five ratings."""
    return df.filter(
        (F.col("avg_turk_ratings") > 0.5) & (F.col("count_turk_ratings") >= 5)
    ).select("avg_turk_ratings", "link")


def describe_column(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles (interpolated).

    Everything is read from value frequencies with their running total, which
    are computed once: no task holds the column, however many values it has.
    """
    known = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    freq = known.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    table = dist_running_sum(freq, [], ["v"], {"upto": "n"})
    sums = table.agg(
        F.struct(
            F.sum("n").alias("t"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")
        ).alias("sums")
    ).scalar()
    placed = table.withColumn("sums", sums)
    t, mean = F.col("sums.t"), F.col("sums.mean")
    deviation = F.sum(F.col("n") * (F.col("v") - mean) * (F.col("v") - mean))
    quartiles = []
    for q in (0.25, 0.5, 0.75):
        at = (t - 1) * q
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col("v")))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("v")))
        part = F.max(at - F.floor(at))
        quartiles.append((low + (high - low) * part).alias(f"p{int(q * 100)}"))
    return placed.agg(
        F.coalesce(F.max(t), F.lit(0).cast("long")).alias("count"),
        F.max(mean).alias("mean"),
        F.sqrt(F.try_divide(deviation, F.max(t - 1).cast("double"))).alias("std"),
        F.min("v").alias("min"),
        *quartiles,
        F.max("v").alias("max"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, most frequent first; nulls are left out."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), col)
    )


def binned_counts(df: DataFrame, col: str = "avg_turk_ratings") -> DataFrame:
    """Count per bin; averages outside (0, 1] have none."""
    return (
        df.filter((F.col(col) > 0) & (F.col(col) <= 1))
        .groupBy(rating_bin(F.col(col)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def article_label_projection(df: DataFrame) -> DataFrame:
    return df.select("link", "avg_turk_ratings", "count_turk_ratings")

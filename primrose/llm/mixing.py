"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.llm.common import WORD, salted_left_join
from primrose.operators.rank import dist_running_sum
from primrose.session import pin


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_weight(text: Column, words: Column) -> Column:
    """Quality weight in (0, 1]: highest for a mean word length of six."""
    mean = F.coalesce(F.char_length(text), F.lit(0)) / F.greatest(words, F.lit(1))
    return F.lit(1.0) / (1.0 + F.abs(mean - 6.0) / 6.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``(source, source_size, target)``, one row per source.

    Sources by code point, null last, get ``weights`` in turn. They share the
    total by weight; a target stops at ``cap`` times its source's size and the
    excess goes to the others by weight. That is the level L with
    target = min(cap * size, L * weight): sources are sorted by the level at
    which they stop, and the first that L does not stop gives L. The windows
    hold one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("__rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    weighed = ranked.withColumn(
        "__w", F.element_at(every, ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("__stop", cap * F.col("source_size") / F.col("__w"))
    order = W.orderBy("__stop", "__rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    spent = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))
    level = weighed.withColumn("__level", (total - spent) / F.sum("__w").over(onward))
    reached = F.min(
        F.when(F.col("__level") <= F.col("__stop"), F.struct("__stop", "__rank", "__level"))
    ).over(W.partitionBy())
    return level.withColumn("__reached", reached["__level"]).select(
        "source",
        "source_size",
        F.least(
            cap * F.col("source_size"), F.coalesce("__reached", F.col("__level")) * F.col("__w")
        ).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    weight: Column | None = None,
    seed: int = 7,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: the id, ``size`` (words), ``source_size``,
    ``target`` of its source, ``copies`` and ``taken`` (words the mix takes).

    A source whose target holds its size several times gives that many whole
    epochs first. The rest of its target is chosen by the exponential keys
    -ln(u) / weight, u a hash of id and seed: documents are sorted by key
    within their source, and are taken up to the remaining budget; the one at
    the border is taken if its middle lies within. ``weight`` (default:
    ``text_weight``) is an expression over ``docs``; null or not above zero
    counts as 1e-6. Reruns agree.

    Running sums are by range partitions (``dist_running_sum``), so a source
    may hold any share of the rows; only ids, sizes and keys move.

    ``row_col``, a column that is unique and not null, is carried through, so
    that the result can be joined back where ids repeat or are null; it settles
    ties, too. Ids alone still give the keys.

    Null text has size 0. Null source is a source of its own, the last. Null
    ids share one u. Rows that repeat are rows of their own. Documents of size
    0 take nothing. An empty table gives an empty result.
    """
    words = word_count(F.col(text_col))
    quality = F.coalesce(weight if weight is not None else text_weight(F.col(text_col), words), F.lit(0.0))
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    row = [] if row_col is None else [F.col(row_col).alias("__mix_row")]
    sizes = pin(
        docs.select(
            F.col(id_col).alias("__id"),
            *row,
            F.col(source_col).alias("source"),
            words.alias("size"),
            (-F.log(u) / F.greatest(quality, F.lit(1e-6))).alias("__key"),
        )
    )
    row = row and ["__mix_row"]
    targets = source_targets(sizes, weights, cap)
    # Null sources must meet too: joined by (is null, value).
    key = [F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source")]
    keyed = salted_left_join(
        sizes.select("__id", *row, "size", "__key", *key),
        targets.select(*key, "source_size", "target"),
        ["__null", "__source"],
        F.struct("__id", *row),
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = keyed.withColumn("__epochs", epochs.cast("long")).withColumn(
        "__rest", F.col("target") - F.col("__epochs") * F.col("source_size")
    )
    summed = dist_running_sum(planned, ["__null", "__source"], ["__key", "__id", "size", *row], {"__upto": "size"})
    chosen = (F.col("__upto") - F.col("size") / 2 <= F.col("__rest")) & (F.col("size") > 0)
    return summed.withColumn("copies", F.col("__epochs") + chosen.cast("long")).select(
        F.col("__id").alias(id_col),
        *[F.col(c).alias(row_col) for c in row],
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("long").alias("copies"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def repeated_by_mix(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns stay.
    Ids must be unique and not null; the join is on them."""
    times = mix.select(F.col(id_col).alias("__mix_id"), F.col("copies").alias("__copies")).filter("__copies > 0")
    joined = docs.join(times, docs[id_col] == times["__mix_id"])
    again = F.explode(F.sequence(F.lit(1), times["__copies"].cast("int")))
    return joined.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), again.alias("n")).select("row.*")

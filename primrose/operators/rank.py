"""Exact global positions and running sums without a single-task window.

``row_number()`` with no partition moves every row into one task. Here rows are
range-partitioned and sorted (one exchange that splits evenly whatever the key
distribution, as long as the order ends in a unique column), numbered inside
their partition, and shifted by the totals of the partitions before. Only the
per-partition totals, one row per shuffle partition, are broadcast.

The layout is read twice (totals, rows), so it is pinned on reliable storage
first: both reads see the same partitions even after an executor is lost.
Callers pass narrow frames (keys and sizes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.session import pin

_SLOT, _PART, _POS = "__slot", "__part", "__pos"
# monotonically_increasing_id(): partition in the upper 31 bits, row in the
# lower 33.
_ROW_BITS = 33


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def range_layout(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` globally sorted and pinned, with partition and position tags."""
    cols = _columns(order)
    laid = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_SLOT, _ROW_BITS).cast("int"))
        .withColumn(_POS, F.col(_SLOT) - F.shiftleft(F.col(_PART).cast("long"), _ROW_BITS))
        .drop(_SLOT)
    )
    return pin(laid)


def _before(totals: DataFrame, value: str, keys: Sequence[str] = ()) -> Column:
    """Sum of ``value`` over the earlier partitions (of the same keys)."""
    w = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def dist_rank(
    df: DataFrame, order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """Add the one-based global position of each row as a long.

    ``order`` must end in a unique key.
    """
    laid = range_layout(df, order)
    totals = laid.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: this window and this broadcast stay tiny.
    offsets = totals.select(_PART, _before(totals, "__n").alias("__offset"))
    return (
        laid.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col(_POS) + F.col("__offset") + 1)
        .drop(_PART, _POS, "__offset")
    )


def dist_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
) -> DataFrame:
    """Running sums inside ``keys``, in ``order``: ``{output: value}``.

    A key may hold any share of the rows: it is spread over as many range
    partitions as it needs. A partition is preceded by rows of the same key
    only for the first key it holds, so the offsets are at most one row per
    partition and can be broadcast whatever the number of keys.
    """
    values = {out: f"__v{i}" for i, out in enumerate(sums)}
    valued = df
    for out, source in sums.items():
        valued = valued.withColumn(values[out], _columns([source])[0])
    laid = range_layout(valued, [*keys, *order])

    totals = laid.groupBy(_PART, *keys).agg(
        *[F.sum(v).alias(v) for v in values.values()],
        F.min(_POS).alias("__first"),
    )
    # Keys lying inside one partition need no offset. What is left is the last
    # key of each partition (it may go on) and the first (it may continue).
    edges = totals.withColumn(
        "__last",
        F.col("__first") == F.max("__first").over(W.partitionBy(_PART)),
    ).filter((F.col("__first") == 0) | F.col("__last"))
    offsets = edges.select(
        _PART,
        *keys,
        "__first",
        *[_before(edges, v, keys).alias(f"{v}_off") for v in values.values()],
    ).filter(F.col("__first") == 0)

    # At position 0 sits the first key of a partition; it alone has an offset.
    joined = laid.join(
        F.broadcast(offsets.drop("__first")), [_PART, *keys], "left"
    )
    w = (
        W.partitionBy(_PART, *keys)
        .orderBy(_POS)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    out = joined
    for name, v in values.items():
        out = out.withColumn(
            name, F.sum(v).over(w) + F.coalesce(F.col(f"{v}_off"), F.lit(0))
        )
    return out.drop(
        _PART, _POS, *values.values(), *[f"{v}_off" for v in values.values()]
    )

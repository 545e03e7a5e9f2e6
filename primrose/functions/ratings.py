"""Expressions over the five rating slots of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from primrose.schemas import RATING_SLOTS


def _total(values: list[Column]) -> Column:
    return reduce(lambda left, right: left + right, values)


def count_ratings_expr(slots: list[str] = RATING_SLOTS) -> Column:
    """Number of non-blank slots."""
    return _total([F.when(F.col(c) != "", 1).otherwise(0) for c in slots])


def mean_rating_expr(slots: list[str] = RATING_SLOTS) -> Column:
    """Mean of the integer ratings given; null without any.

    Deviation: the original yields NaN, which behaves the same in
    :func:`sensitive_label`.
    """
    # Most slots are blank, and a failing cast is fifty times the price of the
    # comparison that avoids it.
    values = [F.when(F.col(c) != "", F.col(c).try_cast("int")) for c in slots]
    total = _total([F.coalesce(v, F.lit(0)) for v in values])
    known = _total([F.when(v.isNotNull(), 1).otherwise(0) for v in values])
    return F.try_divide(total.cast("double"), known.cast("double"))


def rating_bin(avg: Column) -> Column:
    """Right-closed bins of (0, 1]; an average of 0 has no bin."""
    return (
        F.when((avg > 0) & (avg <= 0.25), "(0, 0.25]")
        .when((avg > 0.25) & (avg <= 0.5), "(0.25, 0.5]")
        .when((avg > 0.5) & (avg <= 0.75), "(0.5, 0.75]")
        .when((avg > 0.75) & (avg <= 1.0), "(0.75, 1]")
    )


def sensitive_label(avg: Column) -> Column:
    """1 when the average is at least one half, otherwise (and for null) 0."""
    return F.when(avg >= 0.5, 1).otherwise(0)

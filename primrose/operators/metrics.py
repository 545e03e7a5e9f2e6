"""Prediction quality and model inspection.

``pred`` frames have ``label`` and ``prediction``; all figures are conditional
counts in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def hit_set(pred: DataFrame, label: int, key: str = "doc_id") -> DataFrame:
    """Rows of a class that were predicted as that class (the reference set
    intersected with the predicted set; one frame holds both)."""
    return pred.filter((F.col("label") == label) & (F.col("prediction") == label)).select(
        key
    )


def _class_counts(pred: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, predicted and actual rows of class 0 and 1, one row per class."""

    def counts(c: int) -> Column:
        actual, predicted = F.col("label") == c, F.col("prediction") == c
        return F.struct(
            F.lit(c).alias("class"),
            F.count_if(actual & predicted).alias("tp"),
            F.count_if(predicted).alias("predicted"),
            F.count_if(actual).alias("support"),
        )

    return pred.groupBy(*keys).agg(F.array(counts(0), counts(1)).alias("c")).select(
        *keys, F.inline("c")
    )


def _harmonic(p: Column, r: Column) -> Column:
    return F.when((p == 0) | (r == 0), F.lit(0.0)).when(
        p.isNotNull() & r.isNotNull(), F.lit(2.0) * p * r / (p + r)
    )


def precision_recall_f(pred: DataFrame) -> DataFrame:
    """Per class; a figure without a denominator is null, and so is F then."""
    tp = F.col("tp").cast("double")
    rates = _class_counts(pred).select(
        "class",
        F.try_divide(tp, F.col("predicted")).alias("precision"),
        F.try_divide(tp, F.col("support")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    f = F.when(p.isNotNull() & r.isNotNull(), _harmonic(p, r))
    return rates.withColumn("f_measure", f)


def _zero_filled(pred: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    tp = F.col("tp").cast("double")
    rates = _class_counts(pred, keys).select(
        *keys,
        "class",
        F.coalesce(F.try_divide(tp, F.col("predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("support")), F.lit(0.0)).alias("recall"),
        "support",
    )
    return rates.withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def f1_score(pred: DataFrame, label: int = 1) -> DataFrame:
    """F1 of one class; 0 where it is undefined."""
    return _zero_filled(pred).filter(F.col("class") == label).select("f1")


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class, and the support-weighted average row."""
    per_class = _zero_filled(pred).select(
        F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support"
    )
    total = F.sum("support")
    weighted = per_class.agg(
        *[
            F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c)
            for c in ("precision", "recall", "f1")
        ],
        total.alias("support"),
    ).select(F.lit("avg / total").alias("class"), "precision", "recall", "f1", "support")
    return per_class.unionByName(weighted)


def fold_f1(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """F1 of class 1 in every fold."""
    return _zero_filled(pred, (fold,)).filter(F.col("class") == 1).select(fold, "f1")


def cv_summary(scores: DataFrame, score: str = "f1") -> DataFrame:
    """Mean score and twice its population deviation."""
    return scores.agg(
        F.avg(score).alias("mean_f1"), (F.stddev_pop(score) * 2).alias("spread")
    )


def coefficient_density(coefs: DataFrame) -> DataFrame:
    """Number of features and share of non-zero coefficients."""
    return coefs.agg(
        F.count(F.lit(1)).alias("dimensionality"),
        F.avg((F.col("coef") != 0).cast("double")).alias("density"),
    )


def top_coefficients(coefs: DataFrame, bands: int = 3, width: int = 10) -> DataFrame:
    """The highest-weight terms in bands: band 1 holds the top ``width``."""
    top = coefs.orderBy(F.desc("coef"), "feature").limit(bands * width)
    # bands * width rows at most.
    place = F.row_number().over(W.orderBy(F.desc("coef"), "feature"))
    return top.withColumn("place", place).withColumn(
        "band", F.floor((F.col("place") - 1) / width).cast("int") + 1
    )


def informative_features(weights: DataFrame, n: int = 50) -> DataFrame:
    """Feature values with the greatest ratio of class likelihoods.

    ``weights`` is :func:`~primrose.operators.models.naive_bayes_weights`. Only
    values seen under a label take part, so one seen under a single label has
    ratio 1.
    """

    def entry(value: str, p: str) -> Column:
        seen = [
            F.when(F.col(f"{p}_n{c}") > 0, F.col(f"{p}_p{c}")) for c in (0, 1)
        ]
        return F.struct(
            F.lit(value).alias("value"),
            (F.greatest(*seen) / F.least(*seen)).alias("ratio"),
        )

    entries = F.array(entry("true", "true"), entry("absent", "absent"))
    return (
        weights.select("feature", F.inline(entries))
        .filter(F.col("ratio").isNotNull())
        .orderBy(F.desc("ratio"), "feature", "value")
        .limit(n)
    )

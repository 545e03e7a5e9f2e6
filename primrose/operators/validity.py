"""Which articles can be used, and why the others cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: text of a registration page.
REGISTRATION = "Thanks for Registering!"


def _holds_registration(content: Column) -> Column:
    return F.coalesce(F.contains(content, F.lit(REGISTRATION)), F.lit(False))


def classify_validity(df: DataFrame, content: str = "reporter_content") -> DataFrame:
    """``reason``: ``null``, ``none``, ``registration_wall`` or ``ok``."""
    c = F.col(content)
    return df.withColumn(
        "reason",
        F.when(c.isNull(), "null")
        .when(c == "None", "none")
        .when(F.contains(c, F.lit(REGISTRATION)), "registration_wall")
        .otherwise("ok"),
    )


def valid_rows(df: DataFrame) -> DataFrame:
    return classify_validity(df).filter(F.col("reason") == "ok").drop("reason")


def problem_report(df: DataFrame) -> DataFrame:
    return classify_validity(df).filter(F.col("reason") != "ok").select("id", "reason")


def drop_registration_wall(df: DataFrame) -> DataFrame:
    """Only the registration rule; rows without content stay."""
    return df.filter(~_holds_registration(F.col("reporter_content")))


def candidates_by_flag(df: DataFrame) -> DataFrame:
    """Annotation candidates: both flags lose ``'None'``, flag 1 also loses the
    registration page. Missing content stays, as ``NaN != 'None'`` does."""
    c, flag = F.col("reporter_content"), F.col("sensitive_flag")
    named = ~c.eqNullSafe("None")
    return df.filter(
        ((flag == 1) & named & ~_holds_registration(c)) | ((flag == 0) & named)
    )


def candidate_counts(df: DataFrame) -> DataFrame:
    return candidates_by_flag(df).groupBy("sensitive_flag").agg(
        F.count(F.lit(1)).alias("n")
    )


def sensitive_links(df: DataFrame) -> DataFrame:
    return candidates_by_flag(df).filter(F.col("sensitive_flag") == 1).select("link")

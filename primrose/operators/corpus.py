"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.functions.text import simple_tokens


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents, words, mean words per document, vocabulary size.

    Repeats inside a document are removed in its row and its word count rides
    on its first distinct token, so one pass and one exchange of distinct
    tokens give all four figures.
    """
    tokens = docs.select(simple_tokens(F.col(text)).alias("t"))
    spread = tokens.select(
        F.size("t").alias("words"), F.posexplode(F.array_distinct("t")).alias("pos", "token")
    )
    first = F.col("pos") == 0
    return spread.agg(
        F.count_if(first).alias("documents"),
        F.sum(F.when(first, F.col("words"))).alias("words"),
        F.count_distinct("token").alias("vocabulary"),
    ).select(
        "documents",
        "words",
        F.try_divide(F.col("words").cast("double"), F.col("documents")).alias(
            "mean_words"
        ),
        "vocabulary",
    )


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens of the corpus."""
    tokens = F.array_distinct(simple_tokens(F.col(text)))
    return docs.select(F.explode(tokens).alias("token")).distinct()

"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Every stage decides on rows, not on ids: rows with a null id and rows that
repeat an id are judged each by its own text, and stay or go each alone. A stage
that carries decisions back numbers its rows first (``numbered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primrose.llm import exact, mixing, neardup, packing, quality
from primrose.llm.common import kept_table, table
from primrose.llm.queries import MIX_CAP, MIX_WEIGHTS, tokenizer_path

ORACLE_SQL = None  # a trained classifier and hashes of Spark decide


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(*quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with a unique ``__row``, written, so that it cannot change."""
    return kept_table(docs.withColumn("__row", F.monotonically_increasing_id()), label)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id;
    null is below all ids, and of rows that repeat the id the last counts."""
    rows = numbered(docs, "exact-rows")
    # Structs are ordered by their fields, null first: the row settles ties.
    found = exact.exact_groups(
        rows.select(F.struct("doc_id", "__row").alias("__key"), "text"), id_col="__key", keep="largest"
    )
    kept = found.filter("kept").select(F.col("__key.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id;
    null is above all ids, and of rows that repeat the id the first counts."""
    rows = numbered(docs, "near-rows")
    found = neardup.near_duplicates(rows, id_col="__row").select("__row", "component_id")
    ids = found.join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))
    kept = ids.groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = numbered(docs, "mixing-rows")
    mix = mixing.mix_sources(rows, weights=MIX_WEIGHTS, cap=MIX_CAP, row_col="__row")
    return mixing.repeated_by_mix(rows, mix, id_col="__row").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

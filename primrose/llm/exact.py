"""Exact dedup by a content sort. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.llm.common import ascii_lower

HOT_SHARE = 1000
SALTS = 64
HEAD_CHARS = 64


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """Groups of rows whose normalised texts (A-Z lower-cased) are identical.

    Rows are range-partitioned by sampled splitters of the normalised texts and
    sorted there (externally, by Spark), so that equal texts are neighbours;
    the window compares each text with its neighbour in full. A splitter is the
    first ``HEAD_CHARS`` characters and a hash of the rest, never a whole text:
    the driver holds a few kilobytes of them however long the texts are. Only a text with
    more than 1/1000 of all rows is dealt over up to 64 neighbouring ranges by a
    salt; there are fewer than 1,000 such texts, so their hashes, and then the
    totals of their parts, are broadcast. Texts are exchanged once.

    Returns one row per input row: the id, ``keep_id`` (smallest or largest id
    of the group), ``group_size``, ``kept``, ``text_sha256`` of the normalised
    text. Other columns of ``docs`` are not read.

    Null text counts as empty. Of rows that repeat an id with an equal text one
    is kept. Null ids come last: they are kept only where a group has no other.
    An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    src = docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )
    # lower() is coarser than the rule, so it finds every text that is hot.
    src = src.withColumn("__h", F.xxhash64(F.lower("__text")))
    counts = src.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("n"))
    hot = counts.filter(F.col("__n") * HOT_SHARE > total.scalar()).select("__h", F.lit(True).alias("__hot"))
    placed = (
        src.join(F.broadcast(hot), "__h", "left")
        .select(
            "__id",
            ascii_lower(F.col("__text")).alias("__norm"),
            F.coalesce("__hot", F.lit(False)).alias("__hot"),
        )
        .withColumn(
            "__salt",
            F.when(F.col("__hot"), F.pmod(F.xxhash64("__id"), F.lit(SALTS))).otherwise(F.lit(0)),
        )
        .withColumns({"__head": F.substring("__norm", 1, HEAD_CHARS), "__mix": F.xxhash64("__norm")})
        .repartitionByRange("__head", "__mix", "__salt")
    )
    run = W.partitionBy("__head", "__mix", "__salt", "__norm")
    order = F.asc_nulls_last("__id") if keep == "smallest" else F.desc_nulls_last("__id")
    runs = placed.select(
        "__id",
        "__hot",
        F.sha2("__norm", 256).alias("text_sha256"),
        F.row_number().over(run.orderBy(order)).alias("__pos"),
        best("__id").over(run).alias("__run_keep"),
        F.count(F.lit(1)).over(run).alias("__run_rows"),
    )
    # One row for each part of a hot text: at most 1,000 texts of 64 parts.
    merged = (
        runs.filter(F.col("__hot") & (F.col("__pos") == 1))
        .groupBy("text_sha256")
        .agg(best("__run_keep").alias("__keep"), F.sum("__run_rows").alias("__rows"))
        .withColumn("__many", F.lit(True))
    )
    full = runs.join(F.broadcast(merged), "text_sha256", "left")
    # __hot is read in both branches, so that they share one exchange of texts.
    parted = F.col("__hot") & F.col("__many")
    keep_id = F.when(parted, F.col("__keep")).otherwise(F.col("__run_keep"))
    first = F.col("__pos") == 1
    return full.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(parted, F.col("__rows")).otherwise(F.col("__run_rows")).alias("group_size"),
        (first & F.col("__id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )

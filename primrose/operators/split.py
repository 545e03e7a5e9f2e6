"""Row positions, exact train/test split, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.functions.names import parse_snapshot_time
from primrose.operators.rank import dist_rank
from primrose.session import pin

TRAIN_SHARE = 0.75
HASH_DIGITS = 4


def row_index(df: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """Zero-based global row position."""
    return dist_rank(df, order, "rank").withColumn(
        "row_idx", F.col("rank") - 1
    ).drop("rank")


def train_test_split(
    df: DataFrame, seed: int = -42, key: str = "id", share: float = TRAIN_SHARE
) -> DataFrame:
    """``(key, part)``: exactly ``floor(share * n)`` train rows, by seeded md5
    order; ``key`` is unique.

    Only the last train row has to be found, not every rank. Hashes are even,
    so rows are counted per leading hash digits (65,536 buckets at most); the
    bucket holding the cut, 1/65,536 of the rows, is ranked by range partitions;
    every other row is compared with the cut in place, without an exchange. The narrow frame of
    keys and hashes is pinned, so what ``df`` reads is read once.
    """
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    hashed = pin(df.select(key, order.alias("__h")))
    place = F.struct("__h", key)
    bucket = F.conv(F.substring("__h", 1, HASH_DIGITS), 16, 10).cast("int")

    sizes = hashed.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    # At most 16 ** HASH_DIGITS rows: these windows and this sort are small.
    upto = F.sum("__n").over(W.orderBy("__b"))
    total = F.sum("__n").over(W.partitionBy())
    edge = (
        sizes.select(
            "__b",
            (upto - F.col("__n")).alias("before"),
            upto.alias("upto"),
            F.floor(total * F.lit(share)).alias("train_rows"),
        )
        .filter((F.col("before") < F.col("train_rows")) & (F.col("upto") >= F.col("train_rows")))
        .select(F.struct("__b", "before", "train_rows").alias("edge"))
    )
    in_edge = hashed.withColumn("edge", edge.scalar()).filter(bucket == F.col("edge.__b"))
    ranked = dist_rank(in_edge, ["__h", key])
    last = ranked.filter(
        F.col("edge.before") + F.col("rank") == F.col("edge.train_rows")
    ).select(place.alias("last"))
    return hashed.select(
        key, F.when(place <= last.scalar(), "train").otherwise("test").alias("part")
    )


def select_split(df: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` at the saved positions (or ids), with their part."""
    return df.join(snapshot.select(key, "part"), key, "inner")


def split_consistency(df: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: number of usable rows, of saved positions, and whether they
    agree. The caller decides to stop."""
    saved = snapshot.agg(F.count(F.lit(1)).alias("n"))
    return df.agg(F.count(F.lit(1)).alias("valid_rows")).select(
        "valid_rows",
        saved.scalar().alias("saved_rows"),
    ).withColumn("consistent", F.col("valid_rows") == F.col("saved_rows"))


def latest_snapshot(files: DataFrame, name: str = "name") -> DataFrame:
    """The file with the greatest time in its name; the first name on ties."""
    timed = files.select(name, parse_snapshot_time(F.col(name)).alias("ts"))
    return timed.filter(F.col("ts").isNotNull()).orderBy(F.desc("ts"), name).limit(1)

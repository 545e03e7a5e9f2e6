"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from primrose.session import scratch_path

# A word: a run of characters other than space, tab, LF, VT, FF and CR.
# bytes.split() without argument cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SALTS = 16
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back: lineage is cut,
    and whatever executor is lost later, its rows are still there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same on texts of one byte a
    character and is much faster than ``translate``."""
    one_byte = F.octet_length(col) == F.char_length(col)
    return F.when(one_byte, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def held_out(id_col: str) -> Column:
    """The test fold: a fifth of all ids. A null id counts as training row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def salted_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, salts: int = SALTS
) -> DataFrame:
    """Left join where one key may hold any share of ``left``.

    Rows of a key are dealt by ``spread`` over ``salts`` tasks; ``right`` has
    one row for each key and is repeated ``salts`` times. Needed because the
    skew handling of Spark does not split a side that lies under an aggregate.
    """
    a = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*on, "__salt"], "left").drop("__salt")


def hot_left_join(
    left: DataFrame, right: DataFrame, key: str, spread: Column, rows: str, total: int, salts: int = SALTS
) -> DataFrame:
    """As :func:`salted_left_join`, where only hot keys are dealt.

    ``right`` has one row for each key; its column ``rows``, dropped here, says
    how many rows of ``left`` the key has at most, and ``total`` is about their
    sum. A key with more than ``total / HOT_SHARE`` rows is hot: there are at
    most ``HOT_SHARE`` of these, whatever the input, so their names can be
    broadcast. All other keys are exchanged once and ``right`` is not repeated
    for them.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = right.filter(F.col(rows) > limit).select(key, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0))
    a = left.join(F.broadcast(hot), key, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    last = F.when(F.col(rows) > limit, F.lit(salts - 1)).otherwise(F.lit(0))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop(rows)
    return a.join(b, [key, "__salt"], "left").drop("__salt")


class WordHashes(dict):
    """Word bytes -> 64-bit hash; forgets all when it grows past ``bound``."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    a = (a ^ (a >> _SHIFT)) * _ODD
    return (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (order matters)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    last = len(words) - n + 1
    h = mixed(words[:last])
    for j in range(1, n):
        h = mixed(h + words[j : last + j])
    return h


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node of ``edges``; root = smallest node that
    is reachable. Alternates large-star and small-star until nothing changes;
    each round is written to the shared folder. A node may have any number of
    neighbours: neighbours are reduced to their minimum before the exchange
    and the join back is salted, so that no group is gathered.
    """
    here = kept_table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(),
        "edges",
    )
    before, links = None, here.count()
    while True:
        # large star: every neighbour above u moves to the least neighbour of u
        both = here.union(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")
        )
        up = hot_left_join(both.filter("v > u"), least, "u", F.col("v"), "n", 2 * links)
        large = up.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below u, and u itself, move to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        down = hot_left_join(large, low, "u", F.col("v"), "n", links)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        here = kept_table(small.filter("u <> v").distinct(), "edges")
        state = here.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before, links = state, state[0]
    leaves = here.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = leaves.select("root").distinct()
    return leaves.union(roots.select(F.col("root").alias("node"), "root"))


def whole_runs(batches, keys: Sequence[str]):
    """Tables of whole runs of equal ``keys`` from batches sorted by them. What
    is held back is the last run; callers bound the length of a run."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        one = pa.Table.from_batches([batch])
        last = [one.column(k)[-1].as_py() for k in keys]
        # Where the last run of this batch begins.
        low, high = 0, one.num_rows - 1
        while low < high:
            mid = (low + high) // 2
            if [one.column(k)[mid].as_py() for k in keys] == last:
                high = mid
            else:
                low = mid + 1
        if low:
            yield pa.concat_tables([*held, one.slice(0, low)]).combine_chunks()
            held = [one.slice(low)]
        elif held and [held[-1].column(k)[-1].as_py() for k in keys] != last:
            yield pa.concat_tables(held).combine_chunks()
            held = [one]
        else:
            held.append(one)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def run_starts(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Borders of the runs of equal values, with 0 and the length."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([np.flatnonzero(new), [n]])

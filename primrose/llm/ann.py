"""Approximate nearest neighbours: an inverted file whose lists are scanned by
blocks of rotated columns, with a test that abandons candidates early."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.llm.common import kept_table
from primrose.session import ship_package

SAMPLE_ROWS = 16_384
MAX_LISTS = 1024
PROBED_SHARE = 0.7
PART_ROWS = 8192
PART_QUERIES = 2048
COLUMNS = 16
EPSILON = 2.6
ROUNDS = 8


class Index(NamedTuple):
    """Rotation of the augmented space, centroids there, and the largest norm."""

    rotation: np.ndarray
    centroids: np.ndarray
    reach: float


def _rotated(x: np.ndarray, index: Index, query: bool) -> np.ndarray:
    """Vectors get a last column that makes all norms equal (queries: 0), so
    that the largest inner product is the least distance; then they are
    rotated."""
    missing = np.zeros(len(x)) if query else np.sqrt(np.maximum(index.reach**2 - (x * x).sum(1), 0))
    return (np.hstack([x, missing[:, None]]) @ index.rotation).astype(np.float32)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids**2).sum(1)[None, :] - 2 * (x @ centroids.T)


def fit_index(sample: np.ndarray, reach: float, rows: int, seed: int = 5) -> Index:
    """A random rotation, and k-means over a bounded sample; about half the
    root of ``rows`` lists."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    index = Index(rotation, np.zeros((1, width), np.float32), reach)
    x = _rotated(sample, index, query=False)
    lists = int(min(MAX_LISTS, max(1, round(rows**0.5 / 2)), len(x)))
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        near = _distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=lists)
        some = sizes > 0
        centroids[some] = (sums[some] / sizes[some, None]).astype(np.float32)
    return Index(rotation, centroids, reach)


def scan(
    queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, k: int, epsilon: float = EPSILON
) -> list[np.ndarray]:
    """For each rotated query the positions of ``rows`` that may be among its
    ``k`` nearest; ``allowed[q, r]`` says which lists it probes.

    Distances grow by blocks of columns. After ``m`` of ``d`` columns a
    candidate is abandoned if its distance so far, scaled by d / m, exceeds the
    k-th nearest known by the factor (1 + epsilon / root of m) squared: for a
    random rotation that happens to a true neighbour with small probability
    only. Candidates as near as the k-th are never abandoned.
    """
    n, width = rows.shape
    # A first threshold: k allowed rows, measured in full.
    limit = np.full(len(queries), np.inf, np.float32)
    norms = (rows * rows).sum(1)
    own = (queries * queries).sum(1)
    head = min(n, 8 * k)
    for i in range(len(queries)):
        some = np.flatnonzero(allowed[i])[:head]
        if len(some) >= k:
            d = own[i] + norms[some] - 2 * (rows[some] @ queries[i])
            limit[i] = np.partition(d, k - 1)[k - 1]
    slack = 1e-4 * (own + norms.max(initial=0.0))
    first = min(COLUMNS, width)
    q0, r0 = queries[:, :first], rows[:, :first]
    partial = (q0 * q0).sum(1)[:, None] + (r0 * r0).sum(1)[None, :] - 2 * (q0 @ r0.T)
    bound = limit * (1 + epsilon / first**0.5) ** 2 * first / width + slack
    qi, ri = np.nonzero(allowed & (partial <= bound[:, None]))
    d = partial[qi, ri]
    for at in range(first, width, COLUMNS):
        end = min(at + COLUMNS, width)
        gap = queries[qi, at:end] - rows[ri, at:end]
        d = d + (gap * gap).sum(1)
        bound = limit * ((1 + epsilon / end**0.5) ** 2 * end / width if end < width else 1) + slack
        alive = d <= bound[qi]
        qi, ri, d = qi[alive], ri[alive], d[alive]
    out = []
    starts = np.searchsorted(qi, np.arange(len(queries) + 1))
    for i in range(len(queries)):
        mine, dist = ri[starts[i] : starts[i + 1]], d[starts[i] : starts[i + 1]]
        if len(mine) > k:
            mine = mine[dist <= np.partition(dist, k - 1)[k - 1] + slack[i]]
        out.append(mine)
    return out


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series, dtype: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    probed_share: float = PROBED_SHARE,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query:
    ``query_id, rank, vec_id, score`` (double precision, on the original
    vectors), ties to the smaller id.

    The index (rotation, centroids) is fitted on the ``sample_rows`` rows with
    the least hash of their id; every row is filed in the list of its nearest
    centroid. Whole lists form parts of about ``PART_ROWS`` rows; a longer list
    is spread over several. A query goes once to each part that holds a list it
    probes (``probed_share`` of all lists, nearest first); queries go in blocks,
    so neither side of a task is unbounded. Each task returns at most ``k``
    rows a query, measured exactly.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do null ids, nor vectors of another length than the most
    frequent one. Of rows that repeat an id the least vector stands. A query's
    own id is no candidate. An empty table gives an empty result.
    """
    ship_package(vectors.sparkSession)
    as_double = F.col(vector_col).cast("array<double>")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), as_double.alias("v"), is_query.alias("q"))
        .filter(F.col("id").isNotNull() & usable(F.col("v")))
        .groupBy("id")
        .agg(F.min("v").alias("v"), F.max("q").alias("q"))
    )
    rows = kept_table(rows, "vectors")
    out = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), "w").first()
    if most is None:
        return rows.sparkSession.createDataFrame([], out)
    rows = rows.filter(F.size("v") == most["w"])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = rows.agg(F.max(length).alias("reach"), F.sum(F.col("q").cast("long")).alias("queries")).first()
    sample = rows.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").collect()
    index = fit_index(np.array([r["v"] for r in sample]), float(facts["reach"]), most["n"])
    lists = len(index.centroids)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def file_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                r = _rotated(x, shared.value, query=False)
                near = _distances(r, shared.value.centroids).argmin(1)
                yield pd.DataFrame(
                    {
                        "list": near.astype(np.int32),
                        "id": b["id"],
                        "v": [a.tobytes() for a in x],
                        "r": [a.tobytes() for a in r],
                        "q": b["q"],
                    }
                )

    filed = kept_table(rows.mapInPandas(file_rows, "list int, id long, v binary, r binary, q boolean"), "filed")
    # At most MAX_LISTS rows reach the driver.
    sizes = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}
    part_of: dict[int, tuple[int, int]] = {}
    part, held = 0, 0
    for number in range(lists):
        size = sizes.get(number, 0)
        if held and held + size > PART_ROWS:
            part, held = part + 1, 0
        pieces = max(1, -(-size // PART_ROWS))
        part_of[number] = (part, pieces)
        part, held = (part + pieces, 0) if pieces > 1 else (part, held + size)
    first = F.create_map(*[F.lit(x) for n, (p, _) in part_of.items() for x in (n, p)])
    pieces = F.create_map(*[F.lit(x) for n, (_, m) in part_of.items() for x in (n, m)])
    blocks = max(1, -(-int(facts["queries"] or 0) // PART_QUERIES))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = filed.select(
        (first[F.col("list")] + F.pmod(F.xxhash64("id"), pieces[F.col("list")])).cast("int").alias("part"),
        each_block.alias("block"),
        "list",
        "id",
        "v",
        "r",
    )
    probes = max(1, int(np.ceil(probed_share * lists)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["v"])
            r = _rotated(x, shared.value, query=True)
            near = np.argsort(_distances(r, shared.value.centroids), axis=1, kind="stable")[:, :probes]
            got: dict[str, list] = {c: [] for c in ("part", "id", "v", "r", "lists")}
            for i, chosen in enumerate(near):
                by_part: dict[int, list[int]] = {}
                for n in chosen.tolist():
                    start, many = part_of[n]
                    for p in range(start, start + many):
                        by_part.setdefault(p, []).append(n)
                for p, wanted in by_part.items():
                    got["part"].append(p)
                    got["id"].append(b["id"].iloc[i])
                    got["v"].append(x[i].tobytes())
                    got["r"].append(r[i].tobytes())
                    got["lists"].append(wanted)
            yield pd.DataFrame(got)

    asked = filed.filter("q").select("id", "v").mapInPandas(
        ask, "part int, id long, v binary, r binary, lists array<int>"
    )
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def compare(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(x) or not len(q):
            return empty
        ids, vectors = x["id"].to_numpy(), _matrix(x["v"])
        rotated, in_list = _matrix(x["r"], "<f4"), x["list"].to_numpy()
        parts = []
        for at in range(0, len(q), 256):
            some = q.iloc[at : at + 256]
            probed = np.zeros((len(some), lists), bool)
            for i, wanted in enumerate(some["lists"]):
                probed[i, np.asarray(wanted, np.int64)] = True
            allowed = probed[:, in_list] & (some["id"].to_numpy()[:, None] != ids[None, :])
            found = scan(_matrix(some["r"], "<f4"), rotated, allowed, k)
            asked_v = _matrix(some["v"])
            for i, mine in enumerate(found):
                score = (vectors[mine] * asked_v[i]).sum(1)
                best = np.lexsort((ids[mine], -score))[:k]
                parts.append(
                    pd.DataFrame(
                        {"query_id": some["id"].iloc[i], "vec_id": ids[mine][best], "score": score[best]}
                    )
                )
        return pd.concat(parts) if parts else empty

    found = (
        dealt.groupBy("part", "block")
        .cogroup(asked.groupBy("part", "block"))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

"""Hard negatives by anchor-clustered shared lists, as in MAXIMUS.

Anchors are clustered by direction. For each cluster the rows of a block are
sorted once by an upper bound of their score with any member, which follows
from angles: a row at angle t from the centroid is at least t - w from a member,
w being the widest member's angle. Every member walks that one list until the
bound says that nothing below can still count; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.llm.common import kept_table
from primrose.session import ship_package

SAMPLE_ANCHORS = 16_384
MAX_CLUSTERS = 1024
ROUNDS = 8
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 8192
STRIDE = 512  # rows of a list that are measured together
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def fit_centroids(sample: np.ndarray, clusters: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of directions; unit centroids."""
    rng = np.random.default_rng(seed)
    x = _directions(sample)
    centroids = x[rng.permutation(len(x))[:clusters]].copy()
    for _ in range(ROUNDS):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        lengths = np.linalg.norm(sums, axis=1)
        some = lengths > 0
        centroids[some] = sums[some] / lengths[some, None]
    return centroids


def _directions(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; those beyond a long become its ends."""
    most = np.abs(rows).max(initial=0.0) * np.abs(one).max(initial=0.0) * len(one)
    if most < 2**53:
        return (rows @ one).astype(np.int64)
    whole = [int(c) for c in one]
    sums = [sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in rows]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], np.int64)


class Lists:
    """One block of rows, and the shared list of each cluster over it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.lengths = np.linalg.norm(self.x, axis=1)
        self.unit = _directions(self.x)

    def shared(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of their bound for ``members``, and the bounds:
        no member of length 1 has a larger product with a row or a later one."""
        centre = _directions(_directions(members).sum(0, keepdims=True))[0]
        widest = np.arccos(np.clip(_directions(members) @ centre, -1, 1)).max(initial=0.0)
        angle = np.arccos(np.clip(self.unit @ centre, -1, 1))
        # A little more than the rounding of the angles.
        nearest = np.cos(np.maximum(angle - widest - 1e-7, 0.0))
        bound = self.lengths * nearest + 1e-9 * self.lengths
        bound[~np.isfinite(bound)] = np.inf
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def walk(self, order: np.ndarray, bound: np.ndarray, anchor: np.ndarray, wanted, windows, k: int):
        """For each ``(low, high)`` of ``windows`` the first ``k`` rows with a
        score in it among those that ``wanted`` selects, best first, ties to the
        smaller id. Ends where the bound falls below what any window needs."""
        length = float(np.linalg.norm(anchor)) * (1 + 1e-9)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        # An empty window needs nothing.
        needs = [float(low) if low <= high else np.inf for low, high in windows]
        for at in range(0, len(order), STRIDE):
            # The next row's bound certifies all that follow; a tie still counts.
            if bound[at] * length < min(needs):
                break
            mine = order[at : at + STRIDE]
            mine = mine[wanted(mine)]
            if not len(mine):
                continue
            score = products(self.x[mine], anchor)
            for i, (low, high) in enumerate(windows):
                fits = (score >= low) & (score <= high)
                if not fits.any():
                    continue
                s = np.concatenate([best[i][0], score[fits]])
                r = np.concatenate([best[i][1], mine[fits]])
                top = np.lexsort((self.ids[r], -s))[:k]
                best[i] = (s[top], r[top])
                if len(top) == k:
                    needs[i] = float(s[top[-1]])
        return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    sample_anchors: int = SAMPLE_ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``.

    Components become floor(scale * x); a score is the integer inner product
    with the anchor; higher scores come first, ties by the smaller id. An
    anchor's positives are its first ``positives`` other rows of its label; for
    each, its first ``negatives`` rows of another label whose score lies between
    ``low_percent`` and ``high_percent`` of the positive's.

    Rows are dealt into blocks of about ``BLOCK_ROWS`` by a hash of the id, so
    no label or group of equal vectors can fill a task; anchors go, whole
    clusters together, in blocks of about ``BLOCK_ANCHORS``, and each block of
    anchors meets each block of rows once for the positives and once for the
    negatives. What leaves a task is ``positives`` or ``positives * negatives``
    rows an anchor. Centroids are fitted on the ``sample_anchors`` anchors with
    the least hash; they steer the length of walks only, never a result.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part, nor do vectors of another length than
    the most frequent one. Of rows that repeat an id the least (label, vector)
    stands. Zero vectors score 0. Scores beyond a long become its ends. An empty
    table, or one without anchors, gives an empty result.
    """
    ship_package(vectors.sparkSession)
    as_double = F.col(vector_col).cast("array<double>")
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            label.cast("long").alias("label"),
            as_double.alias("v"),
            F.coalesce(is_anchor, F.lit(False)).alias("a"),
        )
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        .groupBy("id")
        .agg(F.min(F.struct("label", "v")).alias("first"), F.max("a").alias("a"))
        .select("id", "first.label", "first.v", "a")
    )
    rows = kept_table(rows, "negatives-rows")
    out = (
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), "w").first()
    if most is None:
        return rows.sparkSession.createDataFrame([], out)
    rows = rows.filter(F.size("v") == most["w"])
    n_anchors = rows.filter("a").count()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], out)
    sample = rows.filter("a").orderBy(F.xxhash64("id")).limit(sample_anchors).select("v").collect()
    clusters = int(min(MAX_CLUSTERS, max(1, round(n_anchors**0.5)), len(sample)))
    centroids = fit_centroids(np.clip(np.array([r["v"] for r in sample]), -1e150, 1e150), clusters)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    blocks = max(1, -(-most["n"] // BLOCK_ROWS))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Integer components, and the nearest centroid of anchors."""
        top = np.finfo(np.float64).max
        for b in batches:
            if len(b):
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(np.stack(b["v"].to_numpy()) * scale), -top, top)
                near = (np.clip(x, -1e150, 1e150) @ shared.value.T).argmax(1)
                yield b.drop(columns="v").assign(v=[a.tobytes() for a in x], cluster=near.astype(np.int32))

    kept = kept_table(
        rows.mapInPandas(whole, "id long, label long, a boolean, v binary, cluster int"), "negatives-vectors"
    )
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # At most MAX_CLUSTERS rows. Small clusters share a block of anchors, a
    # large one is split over several.
    sizes = {r["cluster"]: r["count"] for r in kept.filter("a").groupBy("cluster").count().collect()}
    place: dict[int, tuple[int, int]] = {}
    group, held = 0, 0
    for number, size in sorted(sizes.items()):
        if held and held + size > BLOCK_ANCHORS:
            group, held = group + 1, 0
        pieces = -(-size // BLOCK_ANCHORS)
        place[number] = (group, pieces)
        group, held = (group + pieces, 0) if pieces > 1 else (group, held + size)
    groups = group + (1 if held else 0)
    begins = F.create_map(*[F.lit(x) for c, (g, _) in place.items() for x in (c, g)])
    spread = F.create_map(*[F.lit(x) for c, (_, p) in place.items() for x in (c, p)])
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    anchors = kept.filter("a").select(
        (begins[F.col("cluster")] + F.pmod(F.xxhash64("id", F.lit(1)), spread[F.col("cluster")])).cast("int").alias("grp"),
        "id",
        "label",
        "v",
        "cluster",
    )
    tasks = max(1, blocks * groups)
    dealt = kept.select(each_group.alias("grp"), block.alias("block"), "id", "label", "v").repartition(
        tasks, "grp", "block"
    )

    def asked(frame: DataFrame) -> DataFrame:
        return frame.select("*", each_block.alias("block")).repartition(tasks, "grp", "block")

    def members(x: pd.DataFrame, q: pd.DataFrame):
        """Each anchor of ``q`` with the list of its cluster over ``x``."""
        lists = Lists(x["id"].to_numpy(), x["label"].to_numpy(), _matrix(x["v"]))
        for _, some in q.groupby("cluster", sort=True):
            vectors_of = _matrix(some["v"])
            order, bound = lists.shared(vectors_of)
            for at in range(len(some)):
                yield lists, order, bound, vectors_of[at], some.iloc[at]

    def find_positives(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {c: [] for c in ("id", "positive_id", "score")}
        if len(x) and len(q):
            for lists, order, bound, vector, anchor in members(x, q):
                own, same = int(anchor["id"]), int(anchor["label"])

                def wanted(mine, lists=lists, own=own, same=same):
                    return (lists.labels[mine] == same) & (lists.ids[mine] != own)

                everything = [(-LONG - 1, LONG)]
                ((score, row),) = lists.walk(order, bound, vector, wanted, everything, positives)
                found["id"] += [own] * len(row)
                found["positive_id"] += lists.ids[row].tolist()
                found["score"] += score.tolist()
        return pd.DataFrame(found, dtype="int64")

    first = (
        dealt.groupBy("grp", "block")
        .cogroup(asked(anchors).groupBy("grp", "block"))
        .applyInPandas(find_positives, "id long, positive_id long, score long")
    )
    order = W.partitionBy("id").orderBy(F.desc("score"), "positive_id")
    best = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives)
    best = kept_table(best.drop("r"), "negatives-positives")
    pairs = best.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("score", "positive_id"))).alias("pairs")  # at most ``positives``
    )
    with_pairs = kept_table(
        anchors.join(pairs, "id").select(
            *anchors.columns, F.col("pairs.positive_id").alias("pids"), F.col("pairs.score").alias("scores")
        ),
        "negatives-asked",
    )

    def find_negatives(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        found: dict[str, list] = {c: [] for c in columns}
        if len(x) and len(q):
            for lists, order, bound, vector, anchor in members(x, q):
                same = int(anchor["label"])
                scores = [int(s) for s in anchor["scores"]]
                # low * p <= 100 * n <= high * p, in whole numbers.
                windows = [
                    (max(-(-low_percent * s // 100), -LONG - 1), min(high_percent * s // 100, LONG)) for s in scores
                ]

                def wanted(mine, lists=lists, same=same):
                    return lists.labels[mine] != same

                for p, s, (score, row) in zip(
                    anchor["pids"], scores, lists.walk(order, bound, vector, wanted, windows, negatives), strict=True
                ):
                    found["anchor_id"] += [int(anchor["id"])] * len(row)
                    found["positive_id"] += [int(p)] * len(row)
                    found["positive_score"] += [s] * len(row)
                    found["negative_id"] += lists.ids[row].tolist()
                    found["negative_score"] += score.tolist()
        return pd.DataFrame(found, dtype="int64")

    second = (
        dealt.groupBy("grp", "block")
        .cogroup(asked(with_pairs).groupBy("grp", "block"))
        .applyInPandas(
            find_negatives,
            "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
        )
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        second.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )

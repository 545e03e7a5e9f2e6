"""Decision trees on presence features, grown level by level.

Documents are packed once into blocks that list, for each feature, the rows that
hold it; features are known by a hash that no other feature has. A level reads
the blocks and adds up counts by (node, feature): blocks find the node of a
document from the splits made so far, so no document is written or moved between
levels. A node whose documents fit one task is finished there by the same rules,
all such nodes together in one last pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primrose.session import scratch_path, ship_package

LOCAL_CELLS = 1 << 21  # features of documents that one task may hold
BLOCK_CELLS = 1 << 20
SENT_NODES = 100_000  # the largest tree that goes to every task
# When growth ends, as the original's classifier has them.
ENTROPY_CUTOFF, DEPTH_CUTOFF, SUPPORT_CUTOFF = 0.05, 100, 10
NODES = "node string, depth int, n0 long, n1 long, feature string"


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _weighed(n: Column) -> Column:
    """n * log2(n), 0 at 0."""
    return n * F.log2(F.greatest(n, F.lit(1)))


def _surprise(n0: Column, n1: Column) -> Column:
    """Entropy in bits of two counts, times their sum."""
    return _weighed(n0 + n1) - _weighed(n0) - _weighed(n1)


def split_gain(criterion: str) -> Column:
    """What a split by presence gains, from ``n0, n1`` of the node and ``t0,
    t1`` of its documents that hold the feature. Rounded, so that equal splits
    are equal whatever the order of additions."""
    n0, n1, t0, t1 = (F.col(c) for c in ("n0", "n1", "t0", "t1"))
    if criterion == "entropy":
        children = _surprise(t0, t1) + _surprise(n0 - t0, n1 - t1)
        return F.round((_surprise(n0, n1) - children) / (n0 + n1), 10)
    if criterion == "error":
        wrong = F.least(t0, t1) + F.least(n0 - t0, n1 - t1)
        return (F.least(n0, n1) - wrong).cast("double")
    raise ValueError(f"unknown criterion {criterion!r}")


def _np_weighed(n):
    return n * np.log2(np.maximum(n, 1))


def _np_gain(criterion: str, n0, n1, t0, t1):
    """:func:`split_gain` on arrays."""
    a0, a1 = n0 - t0, n1 - t1
    if criterion == "error":
        return min(n0, n1) - np.minimum(t0, t1) - np.minimum(a0, a1)
    f = _np_weighed
    own = f(n0 + n1) - f(n0) - f(n1)
    children = f(t0 + t1) - f(t0) - f(t1) + f(a0 + a1) - f(a0) - f(a1)
    return np.round((own - children) / (n0 + n1), 10)


def _finish(table: pa.Table, criterion: str, entropy_cutoff: float, depth_cutoff: int, support: int):
    """All nodes below (and with) one node, from its documents."""
    label = table.column("label").to_numpy().astype(np.int64)
    features = table.column("features").combine_chunks()
    names = features.flatten().unique().sort()
    column = pa.compute.index_in(features.flatten(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(label)), features.value_lengths().to_numpy(zero_copy_only=False))
    out = {c: [] for c in ("node", "depth", "n0", "n1", "feature")}
    top = table.column("node")[0].as_py()
    waiting = [(top, len(top), float(table.column("support")[0].as_py()), label, row, column)]
    while waiting:
        node, level, parent_rows, y, r, c = waiting.pop()
        n1 = int(y.sum())
        n0 = len(y) - n1
        own = _np_weighed(n0 + n1) - _np_weighed(n0) - _np_weighed(n1)
        may = level == 0 or (own > entropy_cutoff * (n0 + n1) and parent_rows > support and level < depth_cutoff)
        best = None
        if may and len(c):
            t1 = np.bincount(c, y[r], len(names)).astype(np.int64)
            t0 = np.bincount(c, minlength=len(names)) - t1
            gain = np.where((t0 + t1 > 0) & (t0 + t1 < n0 + n1), _np_gain(criterion, n0, n1, t0, t1), 0.0)
            if gain.max(initial=0.0) > 0:
                best = int(gain.argmax())
        for key, value in zip(out, (node, level, n0, n1, None if best is None else names[best].as_py()), strict=True):
            out[key].append(value)
        if best is not None:
            holds = np.zeros(len(y), bool)
            holds[r[c == best]] = True
            for side in (False, True):
                mine = holds == side
                place = np.cumsum(mine) - 1
                cells = mine[r]
                waiting.append(
                    (node + str(int(side)), level + 1, float(len(y)), y[mine], place[r[cells]], c[cells])
                )
    return pa.table(out, schema=pa.schema(
        [("node", pa.string()), ("depth", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("feature", pa.string())]
    ))


def _finisher(rules: tuple):
    return lambda table: _finish(table, *rules)


def _mark(name: Column, seed: int) -> Column:
    return F.xxhash64(name, F.lit(seed))


def _named(here: DataFrame) -> tuple[DataFrame, int]:
    """``(feature, mark)`` of every feature: a hash that no other has; its seed."""
    names = _kept(here.select(F.explode("features").alias("feature")).distinct(), "tree-names")
    size, seed = names.count(), 0
    while names.select(_mark(F.col("feature"), seed)).distinct().count() < size:
        seed += 1
    return names.withColumn("mark", _mark(F.col("feature"), seed)), seed


_BLOCK = "label binary, marks binary, counts binary, rows binary"


def _packed(batches):
    """Blocks of documents: labels, the marks held, in order, how many documents
    hold each and which."""
    for b in batches:
        sizes = b.column("marks").value_lengths().to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_CELLS, prepend=0))
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])
            marks, code = np.unique(part.column("marks").flatten().to_numpy(), return_inverse=True)
            arrays = (
                part.column("label").to_numpy().astype(np.int8),
                marks,
                np.bincount(code, minlength=len(marks)).astype(np.int32),
                row[np.argsort(code, kind="stable")],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in arrays], ["label", "marks", "counts", "rows"]
            )


def _arrays(r) -> list[np.ndarray]:
    kinds = {"label": np.int8, "marks": np.int64, "counts": np.int32, "rows": np.int32}
    return [np.frombuffer(r[c], t) for c, t in kinds.items()]


def _placed(docs: int, splits: list[tuple[str, int]], marks: np.ndarray, counts: np.ndarray, rows: np.ndarray):
    """Names of the nodes that the splits make, and which one each document is in."""
    names, place, at = [""], {"": 0}, np.zeros(docs, np.int32)
    ends = np.cumsum(counts)
    for node, mark in splits:
        j = int(np.searchsorted(marks, mark))
        holds = np.zeros(docs, np.int32)
        if j < len(marks) and marks[j] == mark:
            holds[rows[ends[j] - counts[j] : ends[j]]] = 1
        mine = at == place[node]
        at[mine] = len(names) + holds[mine]
        for side in "01":
            place[node + side] = len(names)
            names.append(node + side)
    return names, at


def _sized(splits: list, depth: int):
    """``(node, (n0, n1, cells))`` of the nodes of one depth."""

    def sizes(found):
        out = {}
        for r in found:
            label, marks, counts, rows = _arrays(r)
            names, at = _placed(len(label), splits, marks, counts, rows)
            cells = np.bincount(rows, minlength=len(label)) + 1.0
            sums = [np.bincount(at, x, len(names)) for x in (label == 0, label == 1, cells)]
            for i, node in enumerate(names):
                if len(node) == depth:
                    out[node] = out.get(node, 0) + np.array([int(x[i]) for x in sums])
        for node, x in out.items():
            yield node, tuple(x.tolist())

    return sizes


def _counted(splits: list, growing: list[str]):
    """Marks of each growing node in a block, with the documents that hold them."""

    def count(found):
        for r in found:
            label, marks, counts, rows = _arrays(r)
            names, at = _placed(len(label), splits, marks, counts, rows)
            code, where, sign = np.repeat(np.arange(len(marks)), counts), at[rows], label[rows] == 1
            for node in growing:
                mine = where == names.index(node)
                ones = np.bincount(code[mine & sign], minlength=len(marks))
                zeros = np.bincount(code[mine & ~sign], minlength=len(marks))
                held = np.flatnonzero(ones + zeros)
                if len(held):
                    yield node, *(x[held].astype(np.int64).tobytes() for x in (marks, zeros, ones))

    return count


def _listed(batches):
    for b in batches:
        for node, *arrays in zip(*[c.to_pylist() for c in b.columns], strict=True):
            columns = [pa.array(np.frombuffer(x, np.int64)) for x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(columns[0])), *columns], ["node", "mark", "t0", "t1"])


def _best(blocks: DataFrame, names: DataFrame, splits: list, growing: list[tuple], criterion: str) -> list[tuple]:
    """``(node, feature, mark)``: the feature that gains most in each growing
    node, if any gains."""
    spark = blocks.sparkSession
    counted = blocks.rdd.mapPartitions(_counted(splits, [node for node, _, _ in growing]))
    counts = (
        spark.createDataFrame(counted, "node string, marks binary, t0 binary, t1 binary")
        .mapInArrow(_listed, "node string, mark long, t0 long, t1 long")
        .groupBy("node", "mark")
        .agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))
    )
    gains = _kept(
        counts.join(F.broadcast(spark.createDataFrame(growing, "node string, n0 long, n1 long")), "node")
        .withColumn("gain", split_gain(criterion))
        .filter((F.col("gain") > 0) & (F.col("t0") + F.col("t1") < F.col("n0") + F.col("n1")))
        .select("node", "mark", "gain"),
        "tree-gains",
    )
    # Names are looked up only for the marks that gain most.
    most = gains.groupBy("node").agg(F.max("gain").alias("gain"))
    tied = gains.join(F.broadcast(most), ["node", "gain"]).join(names, "mark")
    found = tied.groupBy("node").agg(F.min(F.struct("feature", "mark")).alias("by"))
    return [(r["node"], r["by"]["feature"], r["by"]["mark"]) for r in found.collect()]


def _with_nodes(here: DataFrame, splits: list[tuple[str, str]], small: dict[str, float]) -> DataFrame:
    """Documents of the small nodes, with the node and its parent's documents."""

    def walk(batches):
        for b in batches:
            sizes = b.column("features").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            coded = b.column("features").flatten().dictionary_encode()
            code = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            counts = np.bincount(code, minlength=len(coded.dictionary) + 1)
            by = pa.compute.index_in(pa.array([f for _, f in splits], pa.string()), coded.dictionary).fill_null(-1)
            numbered = list(zip([node for node, _ in splits], by.to_pylist(), strict=True))
            rows = row[np.argsort(code, kind="stable")]
            names, at = _placed(len(sizes), numbered, np.arange(len(counts)), counts, rows)
            nodes = pa.array(names).take(pa.array(at))
            support = pa.array([small.get(x) for x in names], pa.float64()).take(pa.array(at))
            out = pa.RecordBatch.from_arrays(
                [nodes, support, b.column("label"), b.column("features")], ["node", "support", "label", "features"]
            )
            yield out.filter(support.is_valid())

    return here.mapInArrow(walk, "node string, support double, label int, features array<string>")


def fit_tree(
    docs: DataFrame,
    criterion: str = "entropy",
    entropy_cutoff: float = ENTROPY_CUTOFF,
    depth_cutoff: int = DEPTH_CUTOFF,
    support_cutoff: int = SUPPORT_CUTOFF,
) -> DataFrame:
    """``(node, depth, n0, n1, feature)``, written: one row per node; ``node``
    is the path from the root ("1" holds the feature, "0" does not), ``feature``
    is null at a leaf.

    ``docs``: ``(doc_id, label, features)`` with label 0 or 1 and an array of
    distinct names; null is an empty array, other labels take no part. A node is
    split by the feature that gains most (ties: the smaller name), if any does.
    The root is always tried; another node only if its entropy exceeds
    ``entropy_cutoff``, its parent has more than ``support_cutoff`` documents
    and its depth is below ``depth_cutoff``. No documents give no nodes.

    A level of large nodes is one aggregate over (node, feature). A node with at
    most ``LOCAL_CELLS`` features of documents goes to one task, whole. The
    driver knows the large nodes, at most one for ``LOCAL_CELLS`` features in a
    level.
    """
    split_gain(criterion)
    spark = docs.sparkSession
    ship_package(spark)
    here = _kept(
        docs.filter(F.col("label").isin(0, 1)).select(
            F.col("label").cast("int").alias("label"),
            F.coalesce("features", F.array().cast("array<string>")).alias("features"),
        ),
        "tree-documents",
    )
    root = here.agg(
        F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.sum(F.size("features").cast("long") + 1)
    ).first()
    sizes = {"": (root[0], root[1], root[2] or 0)}
    splits, small, upper, depth = [], {}, {}, 0
    while True:
        for node, (n0, n1, cells) in sizes.items():
            if cells <= LOCAL_CELLS:
                small[node] = float(sum(upper[node[:-1]][:2])) if node else math.inf
            else:
                upper[node] = (n0, n1, None)
        large = sorted(node for node in sizes if node in upper)
        growing = []
        for node in large:
            n0, n1, _ = upper[node]
            mixed = _np_weighed(n0 + n1) - _np_weighed(n0) - _np_weighed(n1) > entropy_cutoff * (n0 + n1)
            if not node or (mixed and sum(upper[node[:-1]][:2]) > support_cutoff and depth < depth_cutoff):
                growing.append((node, n0, n1))
        if not growing:
            break
        if not depth:
            names, seed = _named(here)
            marks = F.transform("features", lambda f: _mark(f, seed))
            blocks = _kept(here.select("label", marks.alias("marks")).mapInArrow(_packed, _BLOCK), "tree-blocks")
        found = _best(blocks, names, [(node, mark) for node, _, mark in splits], growing, criterion)
        for node, feature, _ in found:
            upper[node] = (*upper[node][:2], feature)
        splits += sorted(found)
        depth += 1
        made = _sized([(node, mark) for node, _, mark in splits], depth)
        sizes = blocks.rdd.mapPartitions(made).reduceByKey(lambda x, y: tuple(map(sum, zip(x, y)))).collectAsMap()
        sizes = {node: x for node, x in sizes.items() if x[0] + x[1]}
    placed = _with_nodes(here, [(node, feature) for node, feature, _ in splits], small)
    rules = (criterion, entropy_cutoff, depth_cutoff, support_cutoff)
    finished = placed.groupBy("node").applyInArrow(_finisher(rules), NODES)
    known = [(node, len(node), n0, n1, feature) for node, (n0, n1, feature) in upper.items()]
    return _kept(finished.unionByName(spark.createDataFrame(known, NODES)), "tree")


def _walk(tree: DataFrame, here: DataFrame) -> DataFrame:
    """Leaves by one join a level: for trees too large to send."""
    here = _kept(here.withColumn("node", F.lit("")), "tree-walk")
    deepest = tree.agg(F.max("depth")).first()[0]
    done = []
    for depth in range(deepest + 1):
        nodes = tree.filter(F.col("depth") == depth).select("node", "n0", "n1", F.col("feature").alias("by"))
        found = here.join(nodes, "node")
        done.append(found.filter(F.col("by").isNull()).select("doc_id", "n0", "n1", "node"))
        side = F.when(F.array_contains("features", F.col("by")), "1").otherwise("0")
        here = _kept(
            found.filter(F.col("by").isNotNull()).select("doc_id", "features", F.concat("node", side).alias("node")),
            "tree-walk",
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tree_predict(tree: DataFrame, docs: DataFrame, sent_nodes: int = SENT_NODES) -> DataFrame:
    """``(doc_id, prediction, node)`` of ``docs`` ``(doc_id, features)``: the
    more frequent label of the leaf, ties to 1. A tree of at most ``sent_nodes``
    nodes goes to every task; down a larger one the documents walk level by
    level. A tree without nodes predicts nothing."""
    features = F.coalesce("features", F.array().cast("array<string>"))
    here = docs.select("doc_id", features.alias("features"))
    prediction = F.when(F.col("n1") >= F.col("n0"), 1).otherwise(0).alias("prediction")
    rows = tree.limit(sent_nodes + 1).collect()
    if len(rows) > sent_nodes:
        return _walk(tree, here).select("doc_id", prediction, "node")
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast({r["node"]: (r["feature"], r["n0"], r["n1"]) for r in rows})
    kind = here.schema["doc_id"].dataType.simpleString()

    def walk(batches):
        nodes = sent.value
        for b in batches:
            leaves = []
            for held in b.column("features").to_pylist():
                at, own = "", set(held)
                while nodes and nodes[at][0] is not None:
                    at += "1" if nodes[at][0] in own else "0"
                leaves.append(at)
            if nodes:
                counts = [pa.array([nodes[x][i] for x in leaves], pa.int64()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(leaves)], ["doc_id", "n0", "n1", "node"])

    found = here.mapInArrow(walk, f"doc_id {kind}, n0 long, n1 long, node string")
    return found.select("doc_id", prediction, "node")

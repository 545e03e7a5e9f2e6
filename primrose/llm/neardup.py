"""MinHash near-dedup by an LSH forest, links confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.llm.common import (
    WordHashes,
    components,
    gram_hashes,
    hot_left_join,
    kept_table,
    run_starts,
    whole_runs,
)
from primrose.session import ship_package

SHINGLE = 5
PERCENT = 75
TREES = 12
DEPTH = 8  # hashes of a tree; its regions are by the first two
REGION_ROWS = 2048
BLOCK_ROWS = 1024
# Four and a half standard deviations of the estimate from 96 hashes at 0.75.
NEAR_ENOUGH = 0.55
_ODD = np.random.default_rng(20240501).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES = WordHashes()  # one for each worker process; forgets all at a bound
_SIGNED = pa.schema(
    [
        ("id", pa.int64()),
        ("mark", pa.int64()),
        ("node", pa.binary()),
        ("n_shingles", pa.int64()),
        ("tops", pa.list_(pa.int64())),
        ("sig", pa.binary()),
    ]
)
_SIGNED_SQL = "id long, mark long, node binary, n_shingles long, tops array<long>, sig binary"
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence if it has
    fewer words; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = _HASHES.of(words)
    return np.unique(gram_hashes(hashed, min(size, len(hashed))) + np.uint64(min(size, len(hashed))))


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions, in 32 bits."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048][None, :] * _ODD[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text")
        marks = batch.column("mark").to_pylist()
        for start in range(0, len(ids), 1024):
            rows: dict[str, list] = {f.name: [] for f in _SIGNED}
            for i in range(start, min(start + 1024, len(ids))):
                s = shingles(texts[i].as_py())
                rows["id"].append(ids[i])
                rows["mark"].append(marks[i])
                rows["n_shingles"].append(len(s))
                if not len(s):
                    for k in ("node", "tops", "sig"):
                        rows[k].append(None)
                    continue
                sig = signature(s)
                wide = sig.view(np.int64).reshape(TREES, DEPTH // 2)
                rows["node"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows["tops"].append(wide[:, 0])
                rows["sig"].append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict(rows, _SIGNED)


def _agreement(sig: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of rows; the chance that bytes of
    different hashes agree is taken out."""
    n, width = sig.shape
    same = np.zeros((n, n), np.uint8)
    for j in range(width):
        same += sig[:, j][:, None] == sig[:, j][None, :]
    return (same / width - 1 / 256) / (1 - 1 / 256)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given as a matrix."""
    free = np.ones(len(near), bool)
    edges = []
    for root in range(len(near)):
        if not free[root]:
            continue
        free[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(near[at] & free)
            free[found] = False
            edges += [(at, int(f)) for f in found]
            stack += found.tolist()
    return edges


def _candidate_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the candidate graph in each region, or in two blocks
    of a large one."""
    names = ("key", "low", "high")
    for table in whole_runs(batches, names):
        keys = [table.column(k).to_numpy() for k in names]
        nodes = table.column("node").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
        cuts = run_starts(keys)
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        alike = (sig[two] == sig[two + 1]).mean(1) if len(two) else np.zeros(0)
        pairs = [(int(i), int(i) + 1) for i in two[(alike - 1 / 256) / (1 - 1 / 256) >= NEAR_ENOUGH]]
        for start, end in zip(cuts[:-1][size > 2], cuts[1:][size > 2], strict=True):
            near = _agreement(sig[start:end]) >= NEAR_ENOUGH
            pairs += [(int(start) + i, int(start) + j) for i, j in _forest(near)]
        yield pa.RecordBatch.from_pydict(
            {"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]}, _LINKS
        )


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def confirmed_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the true links among ``sets``: pairs by descending
    estimate; pairs that are connected already need no look."""
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        return [(0, 1)] if similar(*sets, percent) else []
    estimate = _agreement(np.stack([signature(s).astype(np.uint8) for s in sets]))
    size = np.array([len(s) for s in sets])
    fits = 100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size)
    i, j = np.nonzero(np.triu(fits & (estimate >= NEAR_ENOUGH), 1))
    order = np.argsort(-estimate[i, j], kind="stable")
    root = np.arange(len(sets))
    links = []
    step = 4096
    at = 0
    while at < len(order):
        some = order[at : at + step]
        at += step
        apart = some[root[i[some]] != root[j[some]]]
        for p in apart.tolist():
            a, b = int(i[p]), int(j[p])
            if root[a] != root[b] and similar(sets[a], sets[b], percent):
                root[root == root[b]] = root[a]
                links.append((a, b))
    return links


def _without_repeats(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``keys``, one row for each of their values."""
    last = None
    for batch in batches:
        names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        new = [here != before for before, here in zip([last, *names], names)]
        last = names[-1] if names else last
        yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("cluster", "low", "high")
        for table in whole_runs(_without_repeats(batches, (*keys, "node")), keys):
            names, last = [], None
            for row in zip(*[table.column(k).to_pylist() for k in keys], strict=True):
                names.append((names[-1] + (row != last)) if names else 0)
                last = row
            nodes, texts = table.column("node").to_pylist(), table.column("text")
            cuts = run_starts([np.array(names)])
            out: list[tuple[bytes, bytes]] = []
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [shingles(texts[k].as_py()) for k in range(start, end)]
                # Another row with the same mark is not the one wanted.
                mine = {
                    nodes[start + k]: s
                    for k, s in enumerate(sets)
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == nodes[start + k]
                }
                known = list(mine)
                out += [(known[a], known[b]) for a, b in confirmed_links(list(mine.values()), percent)]
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, _LINKS)

    return confirm


def _regions(nodes: DataFrame) -> DataFrame:
    """``(key, low, high, node)``: what meets in a task. A region is a common
    prefix of two hashes in a tree's order. One of more than ``REGION_ROWS``
    nodes is dealt into blocks of about half as many, by a hash that differs by
    tree, and every two blocks meet: all pairs of a region are compared, however
    large it is. A node alone in its region takes no part."""
    rows = nodes.select(
        "node", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(TREES - 1)).alias("tree"), "tops")).alias("t")
        # The number of the tree is part of every key.
    ).select("node", F.xxhash64("t.tree", "t.tops").alias("key"))
    counts = kept_table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    many = F.when(F.col("n") > REGION_ROWS, F.ceil(2 * F.col("n") / REGION_ROWS)).otherwise(1).cast("int")
    # As below: one plan at every size.
    placed = (
        rows.join(counts.hint("merge"), "key")
        .withColumn("many", many)
        .withColumn("own", F.pmod(F.xxhash64("node", "key"), "many").cast("int"))
    )
    return (
        kept_table(placed.select("key", "many", "own", "node"), "regions")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        .filter("own <> other or many = 1")
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents with equal shingle sets become one node first, however many they
    are. Nodes that share a region in one of the trees are compared by their
    96 hashes, inside the region's task; what leaves it is a spanning forest of
    the pairs that look near, so its links grow with the nodes, not the pairs.
    Its components are clusters, and two similar nodes lie in one cluster
    unless no tree puts them together (probability 0.00005 at the threshold, at
    every size of the regions).
    Each cluster is confirmed on full sets; one of more than ``BLOCK_ROWS``
    nodes is dealt into blocks, and every two blocks meet in a task. There too
    only a spanning forest of the true links leaves the task. The components of
    true links are the result.

    Null texts and texts without a word have no shingle and no link. A null id
    is linked like any; it is never the least. Rows that repeat an id stay; an
    id with several texts links through each of them, and each row has the
    component of its own text. Whatever the ids, a node is confirmed by rows of
    one id and text, each sent once for every block it meets. An empty table
    gives an empty result.
    """
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Names the rows of one id and text. By the id alone all rows without an id
    # would meet all nodes whose least id is null.
    src = src.withColumn("mark", F.xxhash64(F.col("id").isNull(), "id", "text"))
    signed = kept_table(src.mapInArrow(_sign, _SIGNED_SQL), "signed")
    nodes = kept_table(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("id").alias("least"),
            F.min("mark").alias("mark"),
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c).alias(c) for c in ("tops", "sig")],
        ),
        "nodes",
    )
    regions = _regions(nodes).join(nodes.select("node", "sig"), "node")
    sorted_regions = regions.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    maybe = sorted_regions.mapInArrow(_candidate_links, "a binary, b binary").distinct()
    clusters = kept_table(components(maybe).withColumnRenamed("root", "cluster"), "clusters")

    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    many = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    placed = (
        clusters.join(sizes, "cluster")
        .join(nodes.select("node", "mark"), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), many).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        .filter((F.col("own") != F.col("other")) | (many == 1))
        .select(
            "cluster",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "node",
            "mark",
        )
    )
    # One plan at every size: a broadcast of few members would only hide what
    # the exchange of texts costs.
    texts = placed.hint("merge").join(src, "mark").select("cluster", "low", "high", "node", "text")
    met = texts.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "node")
    links = kept_table(met.mapInArrow(_confirm(percent), "a binary, b binary"), "links")
    linked = components(links).withColumnRenamed("root", "component")

    named = nodes.select("node", "least", "copies").join(linked, "node", "left")
    smallest = named.filter(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("least").alias("smallest")
    )
    told = (
        named.join(smallest, "component", "left")
        .filter((F.col("copies") > 1) | F.col("smallest").isNotNull())
        .select("node", F.coalesce("smallest", "least").alias("smallest"), "copies")
    )
    done = hot_left_join(
        signed.select("id", "node", "n_shingles"), told, "node", F.col("id"), "copies", signed.count()
    )
    component = F.coalesce("smallest", "id")
    return done.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that are not kept; ids must be unique."""
    kept = found.filter("kept").select(F.col(id_col).alias("__kept"))
    return docs.join(kept, docs[id_col] == kept["__kept"], "left_semi")

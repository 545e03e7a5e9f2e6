"""Substring dedup by relative Lempel-Ziv parsing against hash-blocked
reference phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from primrose.llm.common import WordHashes, gram_hashes
from primrose.session import ship_package

WINDOW = 13
ANCHOR = 5
GROUP_ROWS = 2000
# One for each worker process; it forgets all at a bound.
_HASHES = WordHashes()
_NOBODY = np.iinfo(np.int64).max
# Keys travel packed: per (reference block, group) one row of two arrays.
_KEYS = pa.schema([("block", pa.int64()), ("grp", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])
_KEYS_SQL = "block long, grp long, keys binary, owners binary"
_ANSWER = pa.schema([("grp", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary())])
_ANSWER_SQL = "grp long, keys binary, owners binary"


def anchors_of(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``window`` words the hash of its least gram of
    ``anchor`` words. Equal windows have equal anchors."""
    grams = gram_hashes(words, anchor)
    span = window - anchor + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64), grams
    return np.lib.stride_tricks.sliding_window_view(grams, span).min(1), grams


class _Texts:
    """Word hashes of the documents of a group."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.hashes = _HASHES
        self.window, self.anchor = window, anchor
        self.ids = table.column("id").to_pylist()
        self.texts = table.column("text")

    def words(self, i: int) -> list[bytes]:
        return (self.texts[i].as_py() or "").encode("utf-8", "surrogatepass").split()

    def hashed(self) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
        for i, doc in enumerate(self.ids):
            words = self.words(i)
            yield i, doc, words, self.hashes.of(words)


def _packed(keys: list[np.ndarray], owners: list[np.ndarray], group: int, blocks: int) -> pa.Table:
    """Each key with its two least owners in this group, dealt to blocks."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    k, o = _two_least(k, o)
    block = (k % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    k, o, block = k[order], o[order], block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    starts = np.concatenate([[0], cuts]) if len(block) else np.zeros(0, np.int64)
    ends = np.concatenate([cuts, [len(block)]]) if len(block) else starts
    return pa.table(
        {
            "block": pa.array(block[starts], pa.int64()),
            "grp": pa.array(np.full(len(starts), group), pa.int64()),
            "keys": pa.array([k[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            "owners": pa.array([o[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        },
        _KEYS,
    )


def _two_least(k: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, owner) pairs, at most the two least owners of a key."""
    if not len(k):
        return k, o
    order = np.lexsort((o, k))
    k, o = k[order], o[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    k, o = k[new], o[new]
    near = np.zeros(len(k), bool)
    near[2:] = k[2:] == k[:-2]
    return k[~near], o[~near]


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A reference block: the least owner of each key, told to each group that
    sent the key if another document has it too."""
    groups, keys, owners = [], [], []
    for batch in batches:
        for g, k, o in zip(
            batch.column("grp").to_pylist(), batch.column("keys"), batch.column("owners"), strict=True
        ):
            keys.append(np.frombuffer(k.as_buffer(), np.uint64))
            owners.append(np.frombuffer(o.as_buffer(), np.int64))
            groups.append(np.full(len(keys[-1]), g, np.int64))
    if not keys:
        return
    k, o, g = np.concatenate(keys), np.concatenate(owners), np.concatenate(groups)
    del keys, owners, groups
    order = np.lexsort((o, k))
    k, o, g = k[order], o[order], g[order]
    start = np.ones(len(k), bool)
    start[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(start)
    least = o[at]
    most = o[np.concatenate([at[1:], [len(k)]]) - 1]
    run = np.cumsum(start) - 1
    told = (most > least)[run]
    k, g, least = k[told], g[told], least[run][told]
    order = np.lexsort((k, g))
    k, g, least = k[order], g[order], least[order]
    once = np.ones(len(k), bool)
    once[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    k, g, least = k[once], g[once], least[once]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]]) if len(g) else np.zeros(1, np.int64)
    rows = list(zip(cuts[:-1], cuts[1:], strict=True))
    for s in range(0, len(rows), 1000):
        part = rows[s : s + 1000]
        yield pa.RecordBatch.from_pydict(
            {
                "grp": pa.array([int(g[a]) for a, _ in part], pa.int64()),
                "keys": pa.array([k[a:b].tobytes() for a, b in part], pa.binary()),
                "owners": pa.array([least[a:b].tobytes() for a, b in part], pa.binary()),
            },
            _ANSWER,
        )


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and least owners told to a group, by key."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    owners = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("owners")]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, o = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(k)
    return k[order], o[order]


def _lookup(index: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the index holds, and where."""
    if not len(index):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
    return index[at] == keys, at


def factors(window_owner: np.ndarray, doc: int, window: int) -> list[tuple[int, int]]:
    """Greedy parse of a document whose windows have the least owners given:
    spans (start, end) in words. A factor begins at a window that an earlier
    document has and goes on while the next window is held by one; windows
    over the border of two factors are windows too and were looked up, so
    factors that touch or overlap become one span."""
    hit = np.flatnonzero(window_owner < doc)
    if not len(hit):
        return []
    cuts = np.flatnonzero(np.diff(hit) > window) + 1
    return [(int(run[0]), int(run[-1]) + window) for run in np.split(hit, cuts)]


def _pieces(docs: DataFrame, id_col: str, text_col: str, groups: int) -> DataFrame:
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(groups)).alias("grp"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
    )


def duplicate_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    groups: int | None = None,
    removed_text: bool = False,
) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans``
    (array of start and end in words) and, with ``removed_text``, ``kept_text``.

    A window is ``window`` consecutive words. The factors of a document are its
    longest runs of windows that a document with a smaller id has too; all
    words of a factor are removed.

    The reference is indexed in blocks by key hash, and each document is parsed
    against every block that can hold a phrase of it, in two rounds:

    1. Anchors: the least hashed gram in each window, about a quarter as many
       as words. Blocks tell which anchors two documents share.
    2. Windows whose anchor is shared: blocks tell the least owner of each.
       Equal windows have equal anchors, so no shared window is missed; windows
       over factor borders are looked up like the others.

    Documents are dealt by a hash of their id into groups of about
    ``GROUP_ROWS`` (``groups`` of them). A group sends a block each key once,
    with its two least owners, so a passage in a third of all documents costs
    one entry per group, not per document. Texts are exchanged once.

    Null and short texts lose nothing. Rows that repeat an id are one document
    to each other: they remove nothing from one another but give one row each.
    Null ids count as the largest id. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    n = groups or max(1, -(-docs.count() // GROUP_ROWS))
    texts = _pieces(docs, id_col, text_col, n)
    blocks = n

    def owner(doc: int | None) -> int:
        return _NOBODY if doc is None else doc

    def send_anchors(table: pa.Table) -> pa.Table:
        held = _Texts(table, window, anchor)
        keys, owners = [], []
        for _, doc, _, hashed in held.hashed():
            chosen, _ = anchors_of(hashed, window, anchor)
            if len(chosen):
                # Neighbouring windows mostly share their anchor.
                new = np.ones(len(chosen), bool)
                new[1:] = chosen[1:] != chosen[:-1]
                keys.append(chosen[new])
                owners.append(np.full(len(keys[-1]), owner(doc), np.int64))
        return _packed(keys, owners, table.column("grp")[0].as_py(), blocks)

    def send_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        shared, _ = _answers(answers)
        held = _Texts(table, window, anchor)
        keys, owners = [], []
        if len(shared):
            for _, doc, _, hashed in held.hashed():
                chosen, _ = anchors_of(hashed, window, anchor)
                wanted, _ = _lookup(shared, chosen)
                if wanted.any():
                    keys.append(gram_hashes(hashed, window)[wanted])
                    owners.append(np.full(len(keys[-1]), owner(doc), np.int64))
        return _packed(keys, owners, key[0].as_py(), blocks)

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        known, least = _answers(answers)
        held = _Texts(table, window, anchor)
        rows: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text")}
        for i, doc, words, hashed in held.hashed():
            spans: list[tuple[int, int]] = []
            if len(known) and len(words) >= window:
                found, at = _lookup(known, gram_hashes(hashed, window))
                spans = factors(np.where(found, least[at], _NOBODY), owner(doc), window)
            left, at = [], 0
            for a, b in spans:
                left += words[at:a]
                at = b
            left += words[at:]
            kept = b" ".join(left)
            rows["id"].append(doc)
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(left))
            rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            rows["spans"].append([{"start": a, "end": b} for a, b in spans])
            rows["kept_text"].append(kept.decode("utf-8", "replace") if removed_text else None)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        kinds += [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    def told(sent: DataFrame) -> DataFrame:
        dealt = sent.repartition(F.col("block"))
        return dealt.mapInArrow(_shared_keys, _ANSWER_SQL)

    anchors = told(texts.groupBy("grp").applyInArrow(send_anchors, _KEYS_SQL))
    windows = told(
        texts.groupBy("grp").cogroup(anchors.groupBy("grp")).applyInArrow(send_windows, _KEYS_SQL)
    )
    out = "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"
    done = texts.groupBy("grp").cogroup(windows.groupBy("grp")).applyInArrow(cut, out)
    done = done.withColumnRenamed("id", id_col)
    return done if removed_text else done.drop("kept_text")

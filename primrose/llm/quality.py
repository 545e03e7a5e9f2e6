"""Quality classifier: attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.llm.common import held_out
from primrose.session import ship_package

PASSAGE_BYTES = 512
PAIR_BUCKETS = 192
CLASSES = 64
DIMENSIONS = PAIR_BUCKETS + CLASSES + 2
HIDDEN, GATE = 24, 12
TRAIN_ROWS = 4000
TRAIN_BYTES = 16_384
THRESHOLD = 0.3
EPOCHS = 30
_CHUNK_BYTES = 2 << 20


def _byte_classes() -> np.ndarray:
    """Letters by what they are, capitals, digits, and each ASCII sign."""
    out = np.zeros(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 1
        elif c.islower():
            out[b] = 2
        elif c.isupper():
            out[b] = 3
        elif c.isdigit():
            out[b] = 4
        elif c == " ":
            out[b] = 5
        elif c == "\n":
            out[b] = 6
        elif b in signs:
            out[b] = 8 + signs.index(b)
        else:
            out[b] = 7
    return out


_CLASS = _byte_classes()


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of ``PASSAGE_BYTES`` bytes, and the first
    passage of each text. A text has one passage at least; the whole of it is
    covered."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per_text = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.concatenate([[0], np.cumsum(per_text)])
    n = int(first[-1])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    passage = first[text_of] + (np.arange(len(data)) - starts[text_of]) // PASSAGE_BYTES
    kind = _CLASS[data]
    hist = np.bincount(passage * CLASSES + np.minimum(kind, CLASSES - 1), minlength=n * CLASSES)
    # Pairs of neighbouring bytes inside a passage, hashed.
    if len(data) > 1:
        inside = passage[1:] == passage[:-1]
        pair = (data[:-1].astype(np.int64) * 257 + data[1:] * 31) * 2654435761 % 4294967296 % PAIR_BUCKETS
        pairs = np.bincount((passage[1:] * PAIR_BUCKETS + pair)[inside], minlength=n * PAIR_BUCKETS)
        same = np.bincount(passage[1:][inside & (data[1:] == data[:-1])], minlength=n)
    else:
        pairs, same = np.zeros(n * PAIR_BUCKETS), np.zeros(n)
    length = np.bincount(passage, minlength=n)
    x = np.empty((n, DIMENSIONS), np.float32)
    share = np.maximum(length, 1)[:, None]
    x[:, :CLASSES] = np.sqrt(hist.reshape(n, CLASSES) / share)
    x[:, CLASSES : CLASSES + PAIR_BUCKETS] = np.sqrt(pairs.reshape(n, PAIR_BUCKETS) / share)
    x[:, -2] = np.sqrt(same / share[:, 0])
    x[:, -1] = np.log1p(length) / 8
    return x, first


def _forward(x: np.ndarray, first: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["E"] + w["e"])
    v = np.tanh(h @ w["V"] + w["v"])
    u = 1 / (1 + np.exp(-(h @ w["U"] + w["u"])))
    s = (v * u) @ w["a"]
    at = first[:-1]
    size = np.diff(first)
    top = np.maximum.reduceat(s, at)
    ex = np.exp(s - np.repeat(top, size))
    att = ex / np.repeat(np.add.reduceat(ex, at), size)
    z = np.add.reduceat(att[:, None] * h, at, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"h": h, "v": v, "u": u, "att": att, "z": z, "y": y}


def _gradient(x, first, w, label, decay) -> dict[str, np.ndarray]:
    f = _forward(x, first, w)
    size = np.diff(first)
    dy = (f["y"] - label) / len(label)
    g = {"c": f["z"].T @ dy, "d": np.array(dy.sum())}
    dz = np.repeat(dy[:, None] * w["c"][None, :], size, axis=0)
    datt = (dz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["att"] * datt, first[:-1]), size)
    ds = f["att"] * (datt - mean)
    g["a"] = (f["v"] * f["u"]).T @ ds
    dv = ds[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
    du = ds[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
    g |= {"V": f["h"].T @ dv, "v": dv.sum(0), "U": f["h"].T @ du, "u": du.sum(0)}
    dh = (f["att"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
    g |= {"E": x.T @ dh, "e": dh.sum(0)}
    return {k: v + decay * w[k] for k, v in g.items()}


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Weights by Adam on whole bags, 64 documents a step. Without a labelled
    row every score is 0.5."""
    rng = np.random.default_rng(seed)
    w = {
        "E": rng.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, HIDDEN)),
        "e": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "v": np.zeros(GATE),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "u": np.zeros(GATE),
        "a": rng.normal(0, 0.3, GATE),
        "c": np.zeros(HIDDEN),
        "d": np.array(0.0),
    }
    if not texts:
        return Model(np.zeros(DIMENSIONS), np.ones(DIMENSIONS), w)
    x, first = _all_passages(texts)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    x = np.clip((x - mean) / scale, -8, 8)
    y = np.array(labels, float)
    m = {k: np.zeros_like(a) for k, a in w.items()}
    r = {k: np.zeros_like(a) for k, a in w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in batch])
            bags = np.concatenate([[0], np.cumsum(first[batch + 1] - first[batch])])
            g = _gradient(x[rows], bags, w, y[batch], 1e-4)
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                r[k] = 0.999 * r[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(r[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of bounded bytes; a longer text is a run of its own."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > _CHUNK_BYTES:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def _all_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [passages(part) for part in _chunks(texts)]
    sizes = np.concatenate([np.diff(first) for _, first in got])
    return np.concatenate([x for x, _ in got]), np.concatenate([[0], np.cumsum(sizes)])


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    """Score of each text."""
    out = []
    for part in _chunks(texts):
        x, first = passages(part)
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        out.append(_forward(x, first, model.w)["y"])
    return np.concatenate(out) if out else np.zeros(0)


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = TRAIN_ROWS,
    text_bytes: int = TRAIN_BYTES,
) -> tuple[list[bytes], list[int]]:
    """Texts and labels of the ``rows`` labelled rows with the least hash of
    their id (fewer where some have no document; of repeated ids the least
    text), each text cut at ``text_bytes``: a bounded sample. Only its ids are
    joined with the texts.
    Null ids, labels other than 0 and 1, and the held-out fold are left out.
    """
    good = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    ids = (
        good.groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(label_col).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    joined = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("__id"))
    text = F.substring(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"), 1, text_bytes)
    one_each = joined.groupBy("__id").agg(F.min("__label").alias("__label"), F.min(text).alias("t"))
    got = sorted(one_each.collect(), key=lambda r: r["__id"])
    return [bytes(r["t"]) for r in got], [int(r["__label"]) for r in got]


def score_quality(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``id, score, predicted`` of every row, from whole texts.

    Null and empty texts are one empty passage and are scored like any. Null
    ids and repeated rows stay. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("__text").to_pylist()]
            scores = np.asarray(score_texts(texts, shared.value), np.float64)
            # Ids are handed on as they came, null or of any size.
            found = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(found, [id_col, "score", "predicted"])

    src = docs.select(id_col, F.col(text_col).alias("__text"))
    return src.mapInArrow(score, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, with all their
    columns. Rows are judged where they lie; nothing is exchanged."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(score_texts(texts, shared.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)

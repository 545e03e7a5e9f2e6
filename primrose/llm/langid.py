"""Language identification by cross-parsing entropy."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.session import ship_package

TRAIN_CHARS = 16_000
TRAIN_ROWS = 40
MAX_SYMBOLS = 120
UNKNOWN = "und"
_BATCH_CHARS = 2_000_000


class Model(NamedTuple):
    """``step[l, state * symbols + symbol]`` of language ``l``: next state, and
    ``breaks`` added where the phrase ends before that symbol."""

    languages: list[str]
    symbol_of: np.ndarray  # code point -> symbol; 0 is white space and the like
    step: np.ndarray
    symbols: int
    breaks: int
    bits: np.ndarray  # of a phrase, by language: log2 of the length of its text


def letters_only(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Transitions (-1: none) of the automaton of all substrings of ``codes``;
    state 0 is the empty string."""
    move = np.full((2 * len(codes) + 1, symbols), -1, np.int32)
    link, length, last, size = [-1], [0], 0, 1
    for c in codes:
        new = size
        size += 1
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and move[p, c] < 0:
            move[p, c] = new
            p = link[p]
        if p >= 0:
            q = int(move[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = size
                size += 1
                move[twin] = move[q]
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p, c] == q:
                    move[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return move[:size]


def fit(samples: Mapping[str, str], train_chars: int = TRAIN_CHARS) -> Model:
    """One automaton per language, from at most ``train_chars`` characters."""
    languages = sorted(samples)
    texts = {k: " ".join(letters_only(samples[k]).split())[:train_chars] for k in languages}
    languages = [k for k in languages if texts[k]]
    seen: dict[str, int] = {}
    for k in languages:
        for c in texts[k]:
            seen[c] = seen.get(c, 0) + 1
    frequent = sorted((c for c in seen if c != " "), key=lambda c: (-seen[c], c))[: MAX_SYMBOLS - 2]
    symbol = {c: i + 2 for i, c in enumerate(frequent)} | {" ": 0}
    symbols = len(frequent) + 2
    symbol_of = np.zeros(0x110000, np.uint8)
    for point in range(0x30000):  # letters lie below
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            symbol_of[point] = symbol.get(low[:1], 1)
    automata = [suffix_automaton([symbol.get(c, 1) for c in texts[k]], symbols) for k in languages]
    states = max((len(a) for a in automata), default=1) + 1
    breaks = 1 << 24
    step = np.zeros((len(languages), states * symbols), np.int32)
    for i, move in enumerate(automata):
        # Where a phrase cannot go on, it ends and the symbol begins the next
        # one. A symbol the language does not know is a phrase of its own: the
        # last state, which no symbol goes on from.
        alone = len(move)
        start = np.where(move[0] >= 0, move[0], alone)
        full = np.where(move >= 0, move, start[None, :] + breaks)
        full[0] = start
        step[i, : move.size] = full.ravel()
        step[i, move.size : move.size + symbols] = start + breaks
    bits = np.array([np.log2(max(2, len(texts[k]))) for k in languages])
    return Model(languages, symbol_of, step, symbols, breaks, bits)


def _codes(text: str, model: Model) -> np.ndarray:
    """Symbols of a text, runs of white space and signs as one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = model.symbol_of[points]
    blank = s == 0
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    return s[keep]


def phrase_counts(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that a greedy parse of each text needs against the text of each
    language, and the number of symbols. All texts and languages advance by
    one symbol at a time; longer texts go on alone."""
    coded = [_codes(t, model) for t in texts]
    sizes = np.array([len(c) if (c != 0).any() else 0 for c in coded], np.int64)
    order = np.argsort(-sizes, kind="stable")
    n, langs = len(texts), len(model.languages)
    counts = np.zeros((langs, n), np.int64)
    if not langs or not n or not sizes.any():
        return counts.T, sizes
    symbols = model.symbols
    flat = model.step.ravel()
    base = (np.arange(langs, dtype=np.int64) * model.step.shape[1])[:, None]
    longest = sizes[order[0]]
    # One column per text, by descending length, so that the texts that go on
    # are a prefix of the columns.
    tape = np.zeros((longest, n), np.uint8)
    for column, i in enumerate(order):
        tape[: sizes[i], column] = coded[i][: sizes[i]]
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    state = np.zeros((langs, n), np.int64)
    mask = model.breaks - 1
    for t in range(longest):
        k = alive[t]
        got = flat[base + state[:, :k] * symbols + tape[t, :k]]
        counts[:, :k] += got >> 24
        state[:, :k] = got & mask
    out = np.zeros((n, langs), np.int64)
    out[order] = counts.T + 1
    out[sizes == 0] = 0
    return out, sizes


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: bits per symbol by language; the least
    wins (ties: first by name). The score is the share of bits that the winner
    saves against the runner-up (1 if there is none)."""
    phrases, sizes = phrase_counts([t or "" for t in texts], model)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits = phrases * model.bits[None, :] / np.maximum(sizes, 1)[:, None]
    best = bits.argmin(1)
    least = bits[np.arange(len(texts)), best]
    rest = bits.copy()
    rest[np.arange(len(texts)), best] = np.inf
    second = rest.min(1)
    with np.errstate(invalid="ignore"):
        score = np.where(np.isinf(second), 1.0, 1.0 - least / np.maximum(second, 1e-300))
    known = sizes > 0
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
    return names, np.where(known, np.clip(score, 0.0, 1.0), 0.0)


def training_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = TRAIN_ROWS,
    chars: int = TRAIN_CHARS,
) -> dict[str, str]:
    """For each label the texts of the ``rows`` rows with the least hash of
    their id, up to ``chars`` characters in all. Only ids are ranked; labels
    are few, so the chosen ids may be broadcast (``rows`` for each)."""
    labelled = docs.select(id_col, text_col, lang_col).filter(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
    )
    order = W.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    chosen = (
        labelled.select(id_col, lang_col)
        .withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") <= rows)
        .select(F.col(id_col).alias("__id"), "__n")
        .dropDuplicates(["__id"])
    )
    got = (
        labelled.join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
        .select(F.col(lang_col).alias("lang"), "__n", F.substring(F.coalesce(text_col, F.lit("")), 1, chars).alias("text"))
        .collect()
    )
    out: dict[str, str] = {}
    for row in sorted(got, key=lambda r: (r["lang"], r["__n"], r["text"])):
        out[row["lang"]] = (out.get(row["lang"], "") + " " + row["text"])[: 2 * chars]
    return out


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, lang_pred, score`` of every row of ``docs``, from whole texts.

    Null texts and texts without a letter get ``und`` and 0. Null ids and
    repeated rows stay. An empty table gives an empty result. A model without
    a language gives ``und`` for all.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for part in _parts(texts):
                a, b = predict(part, known)
                names += a
                scores += b.tolist()
            # Ids are handed on as they came, null or of any size.
            found = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(found, [id_col, "lang_pred", "score"])

    src = docs.select(id_col, F.col(text_col).alias("__text"))
    return src.mapInArrow(label, f"`{id_col}` {kind}, lang_pred string, score double")


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts whose table of symbols stays within bounds: number of
    texts times the longest."""
    part, longest = [], 0
    for t in texts:
        longest = max(longest, len(t or ""))
        if part and longest * (len(part) + 1) > 40 * _BATCH_CHARS:
            yield part
            part, longest = [], len(t or "")
        part.append(t)
    if part:
        yield part

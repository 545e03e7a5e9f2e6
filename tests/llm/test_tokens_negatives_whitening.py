"""Token counts, hard negatives and whitening against brute force, on small
frames with nulls, ties, repeats, odd texts and foreign columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from primrose.llm import negatives, tokencount, whitening
from primrose.llm.oracle import ORACLE
from primrose.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
WORDS = tokenizer_path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'''  ABCÉéßñ0123!?-=_.中ا😀\n"
    texts = [
        None,
        "",
        "'s 're 'rx ''s !'s 'LL 'l 'v 've'd d'd's '",
        "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>",
        "İstanbul ΣΑΣ ǅ é ½²³ 123 ４５ ́x",
        "a" * 5000,
        "ab" * 3000 + "c" * 999,
        "=" * 3000,
        " " * 5000,
        "\x1c\x1d\x85  x​y\x00",
        "中文字符测试" * 300,
    ]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(400)]


def test_token_counts_equal_the_library(spark, library):
    texts = odd_texts()
    big = 2**53 + 1
    rows = [(None if i == 0 else big + i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("id", "n_bytes", "n_tokens", "lang")}
    )
    got = tokencount.count_tokens(docs.repartition(3), WORDS).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library(texts), strict=True)]
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert tokencount.count_tokens(docs.limit(0), WORDS).collect() == []


def test_token_counts_in_small_groups_and_tables(library, monkeypatch):
    """Long texts go over many chunks and groups; tables are cut back often."""
    with open(WORDS, encoding="utf-8") as file:
        source = file.read()
    for name, value in (("GROUP", 3000), ("SLICE", 500), ("MAX_STATES", 400), ("_COMPILED", {})):
        monkeypatch.setattr(tokencount, name, value)
    texts = odd_texts()[:120]
    assert tokencount.count_texts(texts, source).tolist() == library(texts)


def test_token_counts_of_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op11_token_counts"](spark, SMALL).collect()}
    assert got == dict(zip(texts, library(texts.values()), strict=True))


def test_chunk_maps_compose(library):
    """A chunk that starts inside a word is corrected by its other entries."""
    with open(WORDS, encoding="utf-8") as file:
        symbols, transducer = tokencount.compiled(file.read())
    text = "unbelievable" * 2000
    (whole,) = symbols.slices(text)
    entry = np.zeros(1, np.int32)
    halves = [whole[:777], whole[777:]]
    first = transducer.count(halves[:1], entry)[0]
    assert entry[0] != 0
    second = transducer.count(halves[1:], entry)[0]
    assert [first + second] == library([text])


def brute_negatives(rows, moved=True):
    rows = [
        (i, (lab + 1) % 10 if moved and i % 7 == 0 else lab, [math.floor(256 * x) for x in v])
        for i, v, lab in rows
        if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows)
        for p, j, m in [r for r in ranked if r[2] == label and r[1] != i][:5]:
            fits = [(n, k) for n, k, m in ranked if m != label and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fits)]
    return sorted(out)


def vector_rows(rng, n=700, width=6):
    rows = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) + (rng.random() if i % 3 else 0.0) for _ in range(width)]
        rows.append((i, [float(np.float32(x)) for x in v], rng.randrange(4)))
    rows[200] = (200, [0.0] * width, 1)
    rows[300] = (300, rows[0][1], rows[0][2])
    odd = [(None, rows[1][1], 1), (901, None, 1), (902, [float("nan")] * width, 1), (903, rows[1][1], None)]
    odd += [(904, [None] + rows[1][1][1:], 2), (905, [float("inf")] + rows[1][1][1:], 2)]
    return rows, odd


@pytest.mark.parametrize("stride", [8, 512])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, stride):
    for name, value in (("STRIDE", stride), ("BLOCK_ROWS", 200), ("BLOCK_ANCHORS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows, odd = vector_rows(random.Random(5))
    extra = {c: F.lit("x") for c in ("id", "v", "a", "cluster", "grp", "block", "rank", "score")}
    # A repeated row, and a vector of another length, change nothing.
    more = rows + odd + [rows[100], (906, [1.0], 1)]
    vectors = spark.createDataFrame(more, VECTORS).withColumns(extra).repartition(4)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, moved)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows + odd)


def test_hard_negatives_corner_cases(spark):
    anchors = F.col("vec_id") % 100 == 0
    for rows in ([], [(1, [1.0, 2.0], 1)], [(100, [1.0, 2.0], 1)], [(None, None, None)]):
        vectors = spark.createDataFrame(rows, VECTORS)
        assert negatives.hard_negatives(vectors, anchors, F.col("label")).collect() == []
    # Scores beyond 2**53 are exact; scores beyond a long do not fail.
    wide = [(0, [2.0**30, 1.0], 1), (1, [2.0**5, 1 / 256], 1), (2, [2.0**4, 3 / 256], 2), (3, [1e38, 0.0], 3)]
    found = negatives.hard_negatives(spark.createDataFrame(wide, VECTORS), anchors, F.col("label")).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 2**51 + 256, 2**50 + 768)]


def test_walk_ends_early():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(6000, 8)))
    x[:3000] /= 64
    lists = negatives.Lists(np.arange(6000), np.zeros(6000, int), np.floor(x))
    order, bound = lists.shared(lists.x[5990:5991])
    seen = []

    def wanted(mine):
        seen.append(len(mine))
        return np.ones(len(mine), bool)

    ((score, row),) = lists.walk(order, bound, lists.x[5990], wanted, [(-negatives.LONG, negatives.LONG)], 5)
    exact = lists.x @ lists.x[5990]
    assert row.tolist() == np.lexsort((np.arange(6000), -exact))[:5].tolist() and score[0] == exact.max()
    assert sum(seen) < 3000


def test_hard_negatives_sql(spark):
    folder = "/root/testdata/sf0.01"
    query, sql = QUERIES["op12_hard_negatives"], ORACLE["op12_hard_negatives"]
    assert difference(spark, connect(folder), folder, query, sql) == ""


def check_whitening(rows, got, width, top):
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    covariance = np.cov(fit.astype(float).T.reshape(width, n), bias=True).reshape(width, width)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (np.array(x, float) - sums.astype(float) / n) @ vectors[:, :top] / np.sqrt(values[:top])
    deviations = [sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == top * len(rows) and {r["n"] for r in got} == {n}
    found = np.array([[by_id[i][c]["whitened"] for c in range(1, top + 1)] for i, _, _ in rows])
    signs = np.sign((found * want).sum(0))
    assert np.abs(found * signs - want).max() < 1e-9
    assert [by_id[i][1]["deviation"] for i, _, _ in rows] == deviations
    assert all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 for r in got)
    assert all(r["identity_error"] < 1e-12 for r in got)


def test_whitening_equals_eigh(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 37)
    rows, odd = vector_rows(random.Random(8))
    dropped = [r for r in odd if r[0] in (901, 902, 904, 905)]
    extra = {c: F.lit("x") for c in ("id", "x", "part", "n", "component", "cell")}
    many = spark.createDataFrame(rows + dropped + [(906, [1.0], 1)], VECTORS).withColumns(extra).repartition(7)
    check_whitening(rows, whitening.whiten(many).collect(), 6, 4)


def test_whitening_corner_cases(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()

    assert run([]) == [] and run([(1, None, 1), (2, [], 1)]) == []
    # One vector, repeated under null and repeated ids: no variance.
    same = run([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)])
    assert len(same) == 6
    assert {tuple(r)[2:] for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    # Two dimensions, one of them constant.
    flat = run([(1, [0.0, 3.0], 1), (2, [1.0, 3.0], 1)])
    assert sorted((r["vec_id"], r["component"], round(r["whitened"], 9)) for r in flat) == [
        (1, 1, -1.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 0.0),
    ]
    # Deviations beyond a long become the largest long.
    huge = run([(2**53 + 1, [1e30, 0.0], 1), (2**53 + 3, [0.0, 1.0], 1)])
    assert {(r["vec_id"], r["deviation"]) for r in huge} == {(2**53 + 1, 2**63 - 1), (2**53 + 3, 2**63 - 1)}


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    cases = [(np.sort(rng.random(m) * 10), rng.normal(size=m)) for m in (1, 2, 3, 8, 64)]
    cases.append((np.array([0, 0, 0, 5.0, 5, 7]), rng.normal(size=6)))
    cases.append((np.zeros(9), rng.normal(size=9)))
    cases.append((np.array([1.0, 1 + 1e-13, 2, 1e6]), np.array([1.0, 1e-9, 0, 3])))
    for d, z in cases:
        values, basis = whitening.rank_one(d, np.eye(len(d)), z)
        want = np.diag(d) + np.outer(z, z)
        assert np.abs(basis @ np.diag(values) @ basis.T - want).max() <= 1e-13 * np.abs(want).max()
        assert np.abs(basis.T @ basis - np.eye(len(d))).max() < 1e-13


def test_spectra_combine():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) + 40
    parts = [whitening.with_rows(whitening.nothing(5), p) for p in (x[:1], x[1:40], x[40:])]
    whole = whitening.combined(whitening.combined(parts[0], parts[1]), parts[2])
    centred = x - x.mean(0)
    again = whole.basis @ np.diag(whole.values) @ whole.basis.T
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(0)) and np.allclose(again, centred.T @ centred)

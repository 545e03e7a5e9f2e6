"""Folds fitted side by side against one MLlib model per fold; terms counted for
many rows together against the arrays of each row."""

import random

import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from primrose.functions import adjacent_bigrams, bigram_length_filter, ngram_tokens, term_counts, word_tokens
from primrose.operators import features, folds, logistic, models


@pytest.fixture
def vectors(spark):
    rng = random.Random(4)
    rows = []
    for i in range(90):
        label = int(rng.random() < 0.4)
        cells = {j: float(rng.randrange(1, 4)) for j in range(16) if rng.random() < (0.5 if j % 2 == label else 0.25)}
        kind = Vectors.dense([cells.get(j, 0.0) for j in range(16)]) if i % 7 == 0 else Vectors.sparse(16, cells)
        # Keys repeat, one document is empty.
        rows.append((i - i % 2 if i < 8 else i, Vectors.sparse(16, {}) if i == 50 else kind, float(label)))
    return spark.createDataFrame(rows, ["doc_id", "features", "label"])


def test_folds_equal_one_model_each(vectors, monkeypatch):
    for name, value in (("BLOCK_FEATURES", 5), ("BLOCK_CELLS", 100)):
        monkeypatch.setattr(folds, name, value)
    want = models.cross_validate_f1(vectors, 3, fit=lambda df: models.fit_logistic(df))

    def alone(*_):
        raise AssertionError("a model of its own for a fold")

    monkeypatch.setattr(models, "_fit", alone)
    got = models.cross_validate_f1(vectors, 3)
    assert got.schema == want.schema
    assert sorted((r["fold"], round(r["f1"], 9)) for r in got.collect()) == sorted(
        (r["fold"], round(r["f1"], 9)) for r in want.collect()
    )


def test_small_folds_are_fitted_in_a_task_each(spark, vectors, monkeypatch):
    """The same predictions as by steps over all tasks, which are not made."""
    # Features of one document, some with one value.
    extra = [(i, Vectors.sparse(80, {i % 16: 1.0, **{20 + i % 50 + j: 1.0 + j // 2 for j in range(3)}}), float(i % 3 == 0)) for i in range(0, 50, 9)]
    wide = vectors.filter("doc_id >= 8").rdd.map(
        lambda r: (r[0] + 1000, Vectors.sparse(80, {j: float(x) for j, x in enumerate(r[1].toArray()) if x}), r[2])
    ).collect()
    df = spark.createDataFrame(wide + extra, ["doc_id", "features", "label"])
    rows = df.join(models.stratified_folds(df, 3), "doc_id").persist()
    monkeypatch.setattr(folds, "TASK_CELLS", 0)
    want = sorted(map(str, folds.held_out_predictions(rows, 3, reg=1e-2, tol=1e-3).collect()))
    monkeypatch.setattr(folds, "TASK_CELLS", 1 << 23)
    monkeypatch.setattr(folds, "STEP_CELLS", 50)

    def tasks(*_):
        raise AssertionError("steps over all tasks")

    monkeypatch.setattr(logistic, "_tasks", tasks)
    assert sorted(map(str, folds.held_out_predictions(rows, 3, reg=1e-2, tol=1e-3).collect())) == want and len(want) == rows.count()


def test_folds_that_end_early_warn(vectors):
    rows = vectors.join(models.stratified_folds(vectors, 3), "doc_id")
    with pytest.warns(UserWarning, match="after 1 steps"):
        found = folds.held_out_predictions(rows, 3, max_steps=1)
    assert found.count() == rows.count()


def test_terms_are_counted_for_many_rows_together(spark, monkeypatch):
    """Counts of runs equal those of the token arrays, cut at any row."""
    texts = ["red fox red fox jumps", None, "", "the", "fox", "a b2 Redİ fox_x été fox fox", "red fox " * 9]
    docs = spark.createDataFrame(
        [(i // 2 if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string"
    ).coalesce(1)
    for words in (1 << 20, 4, 1):
        monkeypatch.setattr(features, "COUNTED_WORDS", words)
        for low, high in ((1, 1), (1, 2), (2, 4)):
            tokens = ngram_tokens(F.col("text"), low, high)
            want = docs.select("doc_id", F.inline(term_counts(tokens)))
            got = features.ngram_terms(docs, low, high)
            assert got.schema["n"].dataType == want.schema["n"].dataType
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert features.count_terms(docs.limit(0)).count() == 0


def test_pairs_are_counted_for_many_rows_together(spark, monkeypatch):
    """Counts of pairs equal those of single pairs, cut at any row; no task adds
    up the pairs of its whole partition before the exchange."""
    texts = [
        "Red fox, RED fox (jumps)", None, "", "a", "?!", "ΑΣ Ԫa ΑΣ ... İx i̇x the _ été ÉTÉ", "red fox " * 9, "x.y", "()* b2 [c",
    ]
    rows = [(i, t, [1, 0, None, 7][i % 4]) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").coalesce(1)
    single = docs.select("label", F.inline(adjacent_bigrams(word_tokens(F.col("text")))))
    long = single.filter(bigram_length_filter(F.col("w1"), F.col("w2")))

    def seen(df, *columns):
        return sorted(map(str, df.select(*columns).collect()))

    n = F.count(F.lit(1)).alias("n")
    want = seen(single.groupBy("w1", "w2").agg(n), "w1", "w2", "n")
    labelled = seen(long.groupBy("label", "w1", "w2").agg(n), "label", "w1", "w2", "n")
    table = long.filter("label IN (0, 1)").groupBy("w1", "w2").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")
    )
    both = seen(table, "w1", "w2", "n_pos", "n_neg")
    assert len(want) == 15 and labelled and both
    for words, out in ((1 << 22, 1 << 17), (5, 2), (1, 1)):
        monkeypatch.setattr(features, "PAIRED_WORDS", words)
        monkeypatch.setattr(features, "PAIR_ROWS", out)
        assert len(list(features._pair_counter(iter([])))) == 0
        pairs = features.document_bigrams(docs, counted=True)
        assert seen(pairs.groupBy("w1", "w2").agg(F.sum("n").alias("n")), "w1", "w2", "n") == want
        assert seen(features.label_bigram_counts(docs), "label", "w1", "w2", "n") == labelled
        assert seen(features.bigram_label_table(docs), "w1", "w2", "n_pos", "n_neg") == both
    assert features.document_bigrams(docs.limit(0), counted=True).count() == 0
    for counts in (features.label_bigram_counts(docs), features.bigram_label_table(docs)):
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_pairs_of_batches_are_held_in_bounds(monkeypatch):
    """Small batches are counted together, large ones in pieces."""
    sizes, good = [], features._pairs_counted

    def noting(words, label=None):
        sizes.append(len(words.flatten()))
        return good(words, label)

    monkeypatch.setattr(features, "_pairs_counted", noting)
    monkeypatch.setattr(features, "PAIRED_WORDS", 100)
    rows = [["a", "b"]] * 30 + [None, []] + [["c"] * 250] + [["d", "e", "f"]] * 200
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 7], pa.list_(pa.string()))], ["words"]) for i in range(0, len(rows), 7)]
    for some in (batches, [pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["words"])]):
        sizes.clear()
        found = {}
        for b in features._pair_counter(iter(some)):
            for r in b.to_pylist():
                found[r["w1"], r["w2"]] = found.get((r["w1"], r["w2"]), 0) + r["n"]
        assert found == {("a", "b"): 30, ("c", "c"): 249, ("d", "e"): 200, ("e", "f"): 200}
        assert sum(sizes) == 30 * 2 + 250 + 600 and sorted(sizes)[-2] <= 100 and len(sizes) <= 12

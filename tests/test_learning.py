"""Fits against plain solvers on small frames."""

import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from primrose.operators import features, logistic, models, trees
from primrose.plans import queries
from primrose.session import shared_dir


def corpus(rng, n=60, width=12):
    rows, labels = [], []
    for i in range(n):
        label = int(rng.random() < 0.4)
        labels.append((i, label))
        for j in range(width):
            if rng.random() < (0.6 if (j % 2 == 0) == bool(label) else 0.3):
                rows.append((i, f"t{j:02d}", float(rng.randrange(1, 5))))
    return rows, labels


def plain_logistic(rows, labels, reg=1e-2, share=0.15, steps=60_000):
    """Proximal gradient on dense arrays, to high accuracy."""
    names = sorted({t for _, t, _ in rows})
    place = {d: i for i, (d, _) in enumerate(labels)}
    x = np.zeros((len(labels), len(names) + 1))
    x[:, -1] = 1
    for d, t, v in rows:
        x[place[d], names.index(t)] = v
    y = np.array([2 * label - 1 for _, label in labels])
    l1 = np.full(len(names) + 1, reg * share)
    l2 = np.full(len(names) + 1, reg * (1 - share))
    l1[-1] = l2[-1] = 0
    rate = 1 / (np.linalg.norm(x, 2) ** 2 / 4 / len(y) + reg)
    w = np.zeros(len(names) + 1)
    for _ in range(steps):
        g = x.T @ (-y / (1 + np.exp(y * (x @ w)))) / len(y) + l2 * w
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return dict(zip([*names, ""], w, strict=True))


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks of features and documents, served by several copies."""
    for name, value in (("BLOCK_FEATURES", 5), ("BLOCK_CELLS", 60), ("FAN", 2)):
        monkeypatch.setattr(logistic, name, value)


def test_logistic_equals_a_plain_solver(spark, small_blocks):
    rows, labels = corpus(random.Random(1))
    labels += [(1000, 1), (1001, 0)]  # without terms
    extra = [(0, None, 1.0), (1, "t00x", None), (77, "unlabelled", 1.0)]
    terms = spark.createDataFrame(rows + extra, "doc_id long, term string, value double")
    marks = spark.createDataFrame(labels, "doc_id long, label int")
    fit = logistic.fit_logistic_terms(terms, marks, reg=1e-2, tol=1e-6)
    want = plain_logistic(rows, labels)
    got = {r["feature"]: r["coef"] for r in fit.weights.collect()}
    assert fit.residual <= 1e-6 and set(got) == set(want) - {""}
    assert abs(fit.intercept - want[""]) < 1e-3
    assert all(abs(got[t] - want[t]) < 1e-3 for t in got)
    again = logistic.residuals(fit, terms.filter("term IS NOT NULL AND value IS NOT NULL"), marks, reg=1e-2)
    assert again.agg(F.max("residual")).first()[0] <= 1.001e-6
    # Margins, probabilities and predictions follow from the coefficients.
    margins = {r["doc_id"]: r["margin"] for r in logistic.margins(fit, marks, terms.filter("value IS NOT NULL")).collect()}
    for d in (0, 1, 1000):
        assert abs(margins[d] - fit.intercept - sum(v * got[t] for i, t, v in rows if i == d)) < 1e-9
    found = logistic.margins(fit, marks, terms)
    for r in logistic.probabilities(found).collect():
        assert abs(r["p0"] + r["p1"] - 1) < 1e-12
        assert abs(r["p1"] - 1 / (1 + math.exp(-margins[r["doc_id"]]))) < 1e-9
    assert all((r["prediction"] == 1) == (margins[r["doc_id"]] > 0) for r in logistic.predictions(found, marks).collect())


def test_logistic_bounds(spark):
    rows, labels = corpus(random.Random(2), n=30)
    terms = spark.createDataFrame(rows, "doc_id long, term string, value double")
    marks = spark.createDataFrame(labels, "doc_id long, label int")
    with pytest.warns(UserWarning, match="after 1 steps"):
        assert logistic.fit_logistic_terms(terms, marks, max_steps=1).steps == 1
    with pytest.raises(ValueError):
        logistic.fit_logistic_terms(terms, marks.limit(0))
    # No terms at all: the intercept is the log odds.
    bare = logistic.fit_logistic_terms(terms.limit(0), marks, tol=1e-8)
    ones = sum(label for _, label in labels)
    assert abs(bare.intercept - math.log(ones / (len(labels) - ones))) < 1e-6
    assert bare.weights.count() == 0


def test_logistic_cells_move_as_runs(spark):
    """Neighbouring cells of a document are exchanged as one row; labels join
    them in the blocks, where numbers take as few bytes as they need."""
    rows, labels = corpus(random.Random(5), n=20)
    cells = spark.createDataFrame(sorted(rows) + [(77, "unlabelled", 1.0)], "doc_id int, term string, value double").coalesce(1)
    marks = spark.createDataFrame([*labels, labels[0], (99, 1)], "doc_id long, label int").withColumn("label", F.col("label").cast("double"))
    table = cells.selectExpr("0 AS p", "doc_id AS doc", "xxhash64(term, 0) AS mark", "value")
    runs = table.mapInArrow(logistic._gathered, "p int, doc int, marks binary, value binary").collect()
    assert len(runs) == len({d for d, _, _ in rows}) + 1
    blocks, _ = logistic._pack_blocks(cells, marks, 0, 2)
    names = {r["mark"]: r["term"] for r in cells.select("term", logistic._mark(0)).distinct().collect()}
    found = []
    for r in blocks.collect():
        _, (_, sizes, col, value, label) = logistic._block(r, 2)
        spelled = [names.get(m, "") for m in np.frombuffer(r["marks"], np.int64).tolist()]
        assert value.dtype == np.uint8 and len(label) == len(sizes)
        found += sorted((spelled[c], v) for c, v in zip(col.tolist(), value.tolist(), strict=True))
    # The first document is listed twice and counts with each listing.
    twice = {labels[0][0]: 2}
    want = [(t, v * twice.get(d, 1)) for d, t, v in rows] + [("", twice.get(d, 1)) for d, _ in [*labels, (99, 1)]]
    assert sorted(found) == sorted(want)
    for x in ([0.5, 1.0], [-1.0, 7.0], [1 / 3, 2.0], [70000.0], [300.0], [1e300]):
        assert np.array_equal(logistic._narrow(np.array(x)).astype(np.float64), x)


def test_logistic_packs_by_marks_without_a_join(spark, monkeypatch):
    """Cells are packed by a hash of their term that no other term has; the
    vocabulary is not joined with the cells."""
    rows, labels = corpus(random.Random(3), n=30)
    terms = spark.createDataFrame(rows, "doc_id long, term string, value double")
    marks = spark.createDataFrame(labels, "doc_id long, label int")

    def joined(*_):
        raise AssertionError("the vocabulary is joined with the cells")

    monkeypatch.setattr(logistic, "join_by_term", joined)
    want = logistic.fit_logistic_terms(terms, marks, reg=1e-2).weights.orderBy("feature").collect()
    # A hash with collisions is given up for the next one.
    good = logistic._mark
    monkeypatch.setattr(logistic, "_mark", lambda seed: good(seed) if seed else F.length("term").cast("long").alias("mark"))
    features, seed, _ = logistic.number_features(terms.filter("term IS NOT NULL"))
    assert seed == 1 and features.select("mark").distinct().count() == features.count()
    got = logistic.fit_logistic_terms(terms, marks, reg=1e-2).weights.orderBy("feature").collect()
    assert [r["feature"] for r in got] == [r["feature"] for r in want]
    assert all(abs(a["coef"] - b["coef"]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_logistic_leaves_out_features_that_cannot_move(spark, monkeypatch):
    """A feature too rare to outweigh the penalty has no variable, the single
    features of a document and value share one; the model is the plain solver's."""
    for name, value in (("BLOCK_FEATURES", 40), ("BLOCK_CELLS", 300)):
        monkeypatch.setattr(logistic, name, value)
    rows, labels = corpus(random.Random(6), n=40)
    rows += [(d, f"s{d}x{j}", 1.0 + j % 2) for d, _ in labels[::2] for j in range(5)]
    rows += [(d, f"r{d}", 0.01) for d, _ in labels]
    terms = spark.createDataFrame(rows, "doc_id long, term string, value double")
    marks = spark.createDataFrame(labels, "doc_id long, label int")
    cells, marked = terms, marks.withColumn("label", F.col("label").cast("double"))
    packed, p_blocks = logistic._pack_blocks(cells, marked, 0)
    packed = packed.collect()
    always = spark.range(1).select(F.lit("").alias("term")).select(logistic._mark(0)).first()["mark"]
    judged = dict(logistic._judge(1e-2 * 0.15 * len(labels), always)(x for r in packed for x in logistic._asked(r, p_blocks)))
    held, others = set(), []
    for r in packed:
        answers = {q: dict(x[3]) for q, x in judged.items()}
        runs = logistic._runs(np.frombuffer(r["marks"], np.int64), p_blocks)
        block, features, stood, at = logistic._reduced(r, np.concatenate([answers[q][r["p"]] for q, _, _ in runs]), 3)
        held |= set(features["mark"].tolist())
        others += stood["mark"].tolist()
        assert features["times"].sum() == len(features) + len(stood) and len(at) == len(stood)
        assert block[1].min() >= 1 and block[1].sum() == len(block[2]) == len(block[3])
    common = len({t for _, t, _ in rows if t.startswith("t")})
    assert len(held) == common + 1 + 2 * len(labels[::2]) and len(others) == 3 * len(labels[::2])
    fit = logistic.fit_logistic_terms(terms, marks, reg=1e-2, tol=1e-5)
    want = plain_logistic(rows, labels, steps=20_000)
    got = {r["feature"]: r["coef"] for r in fit.weights.collect()}
    assert set(got) == set(want) - {""} and any(got[t] for t in got if t.startswith("s"))
    assert all(abs(got[t] - want[t]) < 1e-3 for t in got) and not any(got[t] for t in got if t.startswith("r"))
    found = logistic.residuals(fit, terms, marks, reg=1e-2).agg(F.max("residual"), F.count(F.lit(1))).first()
    assert found[0] <= 1.001e-5 and found[1] == len(got)


def test_logistic_leaves_only_coefficients_on_disk(spark, monkeypatch, tmp_path):
    """Blocks, runs and checkpoints of the fit go when nothing reads them."""
    rows, labels = corpus(random.Random(7), n=30)
    terms = spark.createDataFrame(rows, "doc_id long, term string, value double")
    marks = spark.createDataFrame(labels, "doc_id long, label int")
    monkeypatch.setattr(logistic, "CUT_EVERY", 2)
    held, good = [], logistic._sweep

    def noting(session):
        good(session)
        held.append({f.name.partition("-")[0] for f in tmp_path.iterdir()} | {f.name for f in checkpoints.glob("rdd-*")} - before)

    checkpoints = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = {f.name for f in checkpoints.glob("rdd-*")}
    monkeypatch.setattr(logistic, "_sweep", noting)
    monkeypatch.setattr(logistic, "scratch_path", lambda _, label: str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}"))
    fit = logistic.fit_logistic_terms(terms, marks, reg=1e-2)
    assert fit.steps > 4 and held[-1] == {"coefficients"}
    # While it runs: three things that every step reads, and one state.
    assert len(held) > 4 and all(len(x) <= 4 for x in held[2:])


def test_kernel_machine_without_a_vocabulary(spark):
    """Where the vocabulary is too large for the driver, words are hashes; words
    that only the other documents have do not count."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words[: 20 if i % 2 else 30], k=8)), float(i % 2)) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label double")
    texts = ["word1 word1 word2", "word1 word1 word2 unseen", "unseen", "", None, "word1 word1 word2"]
    test = spark.createDataFrame([(i // 2, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, label double")
    fitted = models.fit_kernel_features(train, "Basic", vocab_limit=3)
    assert fitted.size == len({w for _, t, _ in rows for w in t.split()})
    found = sorted((r["doc_id"], sorted(r["features"])) for r in fitted.transform(test).collect())
    one, two = (spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("word1", "word2"))
    full = sorted([one, one, two])
    assert found == sorted([(0, full), (0, full), (1, []), (1, []), (2, []), (2, full)])
    mapped = models.fourier_features(fitted.transform(train, known=True), 0.05, dim=4096).orderBy("doc_id").collect()
    z = np.array([r["features"].toArray() for r in mapped])
    x = np.array([[t.split().count(w) for w in words] for _, t, _ in rows])
    want = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.1
    with pytest.warns(UserWarning, match="not converged after 3 iterations"):
        model = models.fit_rbf_svm(fitted.transform(train, known=True), fitted.size, dim=64, max_iter=3)
    assert models.predict(model, fitted.transform(test)).count() == len(texts)
    assert isinstance(models.fit_kernel_features(train, "Basic"), models.Featurizer)


def weighed(n):
    return n * math.log2(n) if n else 0.0


def plain_tree(rows, criterion="entropy", cutoff=0.05, most=100, support=10, node="", parent=math.inf):
    """The tree as a recursion over lists of (label, set of features)."""
    n1 = sum(label for label, _ in rows)
    n0 = len(rows) - n1
    entropy = weighed(n0 + n1) - weighed(n0) - weighed(n1)
    best = None
    if not node or (entropy > cutoff * len(rows) and parent > support and len(node) < most):
        for f in sorted(set().union(*[held for _, held in rows])):
            t1 = sum(label for label, held in rows if f in held)
            t0 = sum(f in held for _, held in rows) - t1
            if t0 + t1 == len(rows):
                continue
            if criterion == "error":
                gain = min(n0, n1) - min(t0, t1) - min(n0 - t0, n1 - t1)
            else:
                parts = sum(
                    weighed(a + b) - weighed(a) - weighed(b) for a, b in ((t0, t1), (n0 - t0, n1 - t1))
                )
                gain = round((entropy - parts) / len(rows), 10)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f)
    if best is None:
        return [(node, len(node), n0, n1, None)]
    out = [(node, len(node), n0, n1, best[1])]
    for side in "01":
        part = [r for r in rows if (best[1] in r[1]) == (side == "1")]
        out += plain_tree(part, criterion, cutoff, most, support, node + side, len(rows))
    return out


@pytest.mark.parametrize("criterion, cells", [("entropy", 0), ("entropy", 150), ("error", 1 << 21)])
def test_tree_equals_a_plain_recursion(spark, monkeypatch, criterion, cells):
    """The same tree by levels, in one task, and by both together."""
    monkeypatch.setattr(trees, "LOCAL_CELLS", cells)
    rng = random.Random(3)
    rows = [
        (i, int(rng.random() < 0.4), [f"f{j}" for j in range(8) if rng.random() < 0.15 + 0.1 * j]) for i in range(70)
    ]
    rows = [(i, int(lab or ("f2" in fs and "f5" not in fs)), fs) for i, lab, fs in rows]
    schema = "doc_id long, label int, features array<string>"
    docs = spark.createDataFrame([*rows, (900, 1, None), (901, None, ["f0"]), (902, 7, ["f0"])], schema)
    want = plain_tree([(lab, set(fs)) for _, lab, fs in rows] + [(1, set())], criterion, support=4)
    tree = trees.fit_tree(docs, criterion, support_cutoff=4)
    assert sorted(map(tuple, tree.collect()), key=str) == sorted(want, key=str)
    # Documents end at the leaf of their path, whichever way they walk.
    leaves = {n: int(n1 >= n0) for n, _, n0, n1, f in want if f is None}
    by_path = {r["doc_id"]: (r["node"], r["prediction"]) for r in trees.tree_predict(tree, docs).collect()}
    walked = {r["doc_id"]: (r["node"], r["prediction"]) for r in trees.tree_predict(tree, docs, sent_nodes=0).collect()}
    assert by_path == walked and len(by_path) == len(rows) + 3
    assert all(leaves[node] == p for node, p in by_path.values())


def test_tree_levels_move_no_documents(spark, monkeypatch):
    """Documents are written once, however many levels the tree has; hashes of
    names that meet are given up for the next ones."""
    rng = random.Random(6)
    rows = [(i, int(rng.random() < 0.5), [f"f{'x' * j}" for j in range(6) if rng.random() < 0.5]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, label int, features array<string>")
    want = trees.fit_tree(docs, support_cutoff=4).collect()
    written, kept, good = [], trees._kept, trees._mark
    monkeypatch.setattr(trees, "_kept", lambda df, label: written.append(label) or kept(df, label))
    monkeypatch.setattr(trees, "LOCAL_CELLS", 20)
    monkeypatch.setattr(trees, "BLOCK_CELLS", 40)
    monkeypatch.setattr(trees, "_mark", lambda x, seed: good(x, seed) if seed else F.pmod(F.length(x), F.lit(2)).cast("long"))
    got = trees.fit_tree(docs, support_cutoff=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 7
    assert written.count("tree-documents") == written.count("tree-blocks") == 1


def test_tree_bigrams_are_selected_once(spark, monkeypatch, tmp_path):
    """The bigrams of the train part are counted once for selection, totals and
    both parts."""
    texts = ["red fox jumps over red fox", "blue whale sings under blue whale", "red fox sings"]
    docs = [(i, texts[i % 3]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    counted, good = spark.sparkContext.accumulator(0), features._counted_bigrams

    def seen(n):
        counted.add(1)
        return n

    tick = F.udf(seen, "int").asNondeterministic()

    def counting(text):
        return F.when(tick(F.length(text)) >= 0, good(text))

    monkeypatch.setattr(features, "_counted_bigrams", counting)
    rows = queries.QUERIES["fit_decision_tree"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in rows if r["label"] == r["prediction"]) == sum(r["n"] for r in rows) > 0
    assert 0 < counted.value <= 60


def test_tree_corner_cases(spark):
    schema = "doc_id long, label int, features array<string>"
    nothing = spark.createDataFrame([], schema)
    tree = trees.fit_tree(nothing)
    assert tree.count() == 0
    one = spark.createDataFrame([(1, 1, ["a"]), (2, 1, ["b"])], schema)
    assert trees.tree_predict(tree, one).count() == 0
    pure = trees.fit_tree(one)
    assert [tuple(r) for r in pure.collect()] == [("", 0, 0, 2, None)]
    assert {r["prediction"] for r in trees.tree_predict(pure, one).collect()} == {1}
    with pytest.raises(ValueError):
        trees.fit_tree(one, "other")


def test_bayes_folds_equal_single_fits(spark):
    """Each fold's F1 is that of a model fitted on the other folds alone."""
    rng = random.Random(9)
    rows, labels = corpus(rng, n=80)
    held = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(3, "only")], "doc_id long, feature string")
    marks = spark.createDataFrame([(d, lab, rng.randrange(4)) for d, lab in labels], "doc_id long, label int, fold int")
    got = {r["fold"]: r["f1"] for r in models.cross_validate_bayes(held, marks, 4).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k in range(4):
        rest, own = marks.filter(F.col("fold") != k), marks.filter(F.col("fold") == k)
        weights = models.naive_bayes_weights(held.join(rest, "doc_id").select("doc_id", "label", "feature"), rest)
        pred = models.naive_bayes_predict(weights, rest, own, held.join(own.select("doc_id"), "doc_id"))
        seen = pred.join(own, "doc_id").collect()
        tp = sum(r["label"] * r["prediction"] for r in seen)
        both = sum(r["label"] + r["prediction"] for r in seen)
        assert abs(got[k] - (2 * tp / both if both else 0)) < 1e-12

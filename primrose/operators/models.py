"""Learning operators: naive Bayes as joins and sums, the rest on MLlib."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import lru_cache, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from primrose.functions.text import (
    content_terms,
    ngram_tokens,
    simple_tokens,
    tfidf_tokens,
)
from primrose.operators.features import (
    join_by_term,
    present_bigrams,
    selected_names,
    top_bigrams,
)
from primrose.operators.folds import held_out_predictions
from primrose.operators.metrics import cv_summary, fold_f1
from primrose.operators.rank import dist_rank
from primrose.session import scratch_path, ship_package

# --- naive Bayes ------------------------------------------------------------


def naive_bayes_weights(labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and smoothed likelihoods, one row per feature.

    ``labelled``: ``(doc_id, label, feature)``, the true features; ``labels``:
    ``(doc_id, label)`` with label 0 or 1. For label rows N and B distinct
    values of the feature (true, and absent if any document lacks it):
    P(value | label) = (c + 0.5) / (N + 0.5 B). Columns ``true_n0 .. absent_p1``.
    """
    n = labels.agg(
        F.struct(
            F.count_if(F.col("label") == 0).alias("n0"),
            F.count_if(F.col("label") == 1).alias("n1"),
        ).alias("n")
    ).scalar()
    counts = labelled.groupBy("feature").agg(
        F.count_if(F.col("label") == 0).alias("true_n0"),
        F.count_if(F.col("label") == 1).alias("true_n1"),
    )
    counted = counts.withColumn("n", n)
    for c in (0, 1):
        counted = counted.withColumn(
            f"absent_n{c}", F.col(f"n.n{c}") - F.col(f"true_n{c}")
        )
    some_absent = (F.col("absent_n0") + F.col("absent_n1")) > 0
    bins = F.lit(1.0) + F.when(some_absent, 1.0).otherwise(0.0)
    for c in (0, 1):
        rows = F.col(f"n.n{c}") + F.lit(0.5) * bins
        for value in ("true", "absent"):
            counted = counted.withColumn(
                f"{value}_p{c}", (F.col(f"{value}_n{c}") + F.lit(0.5)) / rows
            )
    return counted.drop("n")


def naive_bayes_table(labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Long form ``(label, feature, value, n, prob)``. A value that occurs
    under neither label is left out."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.lit(value).alias("value"),
                F.col(f"{value}_n{c}").alias("n"),
                F.col(f"{value}_p{c}").alias("prob"),
                (F.col(f"{value}_n0") + F.col(f"{value}_n1")).alias("seen"),
            )
            for c in (0, 1)
            for value in ("true", "absent")
        ]
    )
    return (
        naive_bayes_weights(labelled, labels)
        .select("feature", F.inline(rows))
        .filter(F.col("seen") > 0)
        .drop("seen")
    )


def naive_bayes_predict(
    weights: DataFrame,
    labels: DataFrame,
    docs: DataFrame,
    features: DataFrame,
    absent_counts: bool | Column = False,
) -> DataFrame:
    """``(doc_id, score0, score1, prediction)`` of every row of ``docs``.

    Scores are log prior plus the log likelihoods of the document's features;
    features unknown to the model are skipped, ties go to the larger label.
    With ``absent_counts`` (for all features, or those a condition on
    ``feature`` selects) a feature that is missing from a document counts as its
    false value; then the sum over all such features is one constant per label
    and only present features add a correction.

    A very common feature is dealt over several tasks (``join_by_term``).
    """
    prior = labels.agg(
        F.struct(
            *[
                F.log(
                    (F.count_if(F.col("label") == c) + 0.5)
                    / (F.count(F.lit(1)) + 0.5 * 2)
                ).alias(f"p{c}")
                for c in (0, 1)
            ]
        ).alias("p")
    ).scalar()

    fixed = F.lit(absent_counts) if isinstance(absent_counts, bool) else absent_counts

    def gain(c: int) -> Column:
        true = F.log(f"true_p{c}")
        return F.when(fixed, true - F.log(f"absent_p{c}")).otherwise(true)

    model = weights.select("feature", *[gain(c).alias(f"g{c}") for c in (0, 1)])
    sums = (
        join_by_term(features.select("doc_id", "feature"), model, "feature")
        .groupBy("doc_id")
        .agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in (0, 1)])
    )
    scored = docs.select("doc_id").join(sums, "doc_id", "left").withColumn("p", prior)
    some_fixed = absent_counts is not False
    if some_fixed:
        absent = [
            F.sum(F.when(fixed, F.log(f"absent_p{c}"))).alias(f"a{c}") for c in (0, 1)
        ]
        scored = scored.withColumn("a", weights.agg(F.struct(*absent).alias("a")).scalar())
    for c in (0, 1):
        score = F.col(f"p.p{c}") + F.coalesce(F.col(f"g{c}"), F.lit(0.0))
        if some_fixed:
            score = score + F.coalesce(F.col(f"a.a{c}"), F.lit(0.0))
        scored = scored.withColumn(f"score{c}", score)
    return scored.select(
        "doc_id",
        "score0",
        "score1",
        F.when(F.col("score1") >= F.col("score0"), 1).otherwise(0).alias("prediction"),
    )


def bayes_probabilities(scored: DataFrame) -> DataFrame:
    """``(doc_id, p0, p1)`` from the scores of :func:`naive_bayes_predict`.

    Scores further apart than 700 give 0 and 1 in double precision anyway.
    """
    gap = F.least(
        F.greatest(F.col("score0") - F.col("score1"), F.lit(-700.0)), F.lit(700.0)
    )
    return scored.select("doc_id", (1 / (1 + F.exp(gap))).alias("p1")).select(
        "doc_id", (1 - F.col("p1")).alias("p0"), "p1"
    )


def bayes_coefficients(weights: DataFrame) -> DataFrame:
    """``(feature, coef)``: what a feature adds to the log odds of label 1."""
    return weights.select("feature", (F.log("true_p1") - F.log("true_p0")).alias("coef"))


# --- vectors ----------------------------------------------------------------

COUNT_MODELS = ("Basic", "InvDocFreq", "BasicBigram")
PRESENCE_MODELS = ("NLTKSingleWord", "NLTKBigram", "NLTKBigramUnigramCombo")
MODEL_TYPES = COUNT_MODELS + PRESENCE_MODELS


class Featurizer:
    """Token column plus fitted vector stages of one model type.

    Only the vocabulary and the selected bigrams, both of checked size, are
    kept on the driver, as MLlib does.
    """

    def __init__(
        self, tokens: Callable[[Column], Column], stages: PipelineModel, vocabulary: list[str]
    ):
        self._tokens = tokens
        self._stages = stages
        self.vocabulary = vocabulary

    @property
    def size(self) -> int:
        return len(self.vocabulary)

    def transform(self, docs: DataFrame, known: bool = False) -> DataFrame:
        """``known`` says that all words of ``docs`` are those of the fit."""
        with_tokens = docs.withColumn("__tokens", self._tokens(F.col("text")))
        out = self._stages.transform(with_tokens)
        extra = {"__tokens", "__counts", "__scaled"} & set(out.columns)
        return out.drop(*extra)


class MarkedFeaturizer:
    """Token counts without a vocabulary on the driver: ``features`` holds a
    64-bit hash for each token that a document of the fit has, as often as it
    occurs. Only the kernel approximation takes these. Two terms of one hash
    count as one."""

    def __init__(self, train: DataFrame, tokens: Callable[[Column], Column]):
        self._tokens = tokens
        path = scratch_path(train.sparkSession, "marks")
        train.select(F.explode(self._marks()).alias("mark")).distinct().write.parquet(path)
        self._known = train.sparkSession.read.schema("mark long").parquet(path)
        self.size = self._known.count()

    def _marks(self) -> Column:
        marks = F.transform(self._tokens(F.col("text")), lambda w: F.xxhash64(w))
        return F.coalesce(marks, F.array().cast("array<bigint>"))

    def transform(self, docs: DataFrame, known: bool = False) -> DataFrame:
        """The columns of ``docs`` without the text; see :class:`Featurizer`."""
        held = docs.withColumn("features", self._marks()).drop("text")
        if known:
            return held
        # Written, so that the numbers of the rows stay what they are.
        path = scratch_path(docs.sparkSession, "marked")
        held.write.parquet(path)
        rows = docs.sparkSession.read.schema(held.schema).parquet(path)
        rows = rows.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*held.columns).alias("__row"))
        cells = rows.select("doc_id", F.explode("__row.features").alias("mark"))
        found = join_by_term(cells, self._known, "mark").groupBy("doc_id").agg(F.collect_list("mark").alias("__known"))
        joined = rows.join(found, "doc_id", "left").select("__row.*", "__known")
        kept = F.coalesce("__known", F.array().cast("array<bigint>"))
        return joined.withColumn("features", kept).drop("__known")


class VocabularyLimitError(ValueError):
    """More terms than the driver is to hold."""


def _bounded_vocabulary(
    docs: DataFrame, tokens: Callable[[Column], Column], limit: int, binary: bool
) -> CountVectorizerModel:
    """Vocabulary of ``docs``; more than ``limit`` terms is an error rather
    than a silent cut."""
    frame = docs.select(tokens(F.col("text")).alias("__tokens"))
    fitted = CountVectorizer(
        inputCol="__tokens", outputCol="features", vocabSize=limit + 1, binary=binary
    ).fit(frame)
    if len(fitted.vocabulary) > limit:
        raise VocabularyLimitError(f"vocabulary exceeds {limit} terms; raise vocab_limit")
    return fitted


def fit_features(
    train: DataFrame, model_type: str = "Basic", vocab_limit: int = 1 << 21
) -> Featurizer:
    """Fit the features named ``model_type`` on ``train`` (``text``, ``label``).

    An unknown name is an error; the original built nothing for it.
    """
    if model_type in ("Basic", "BasicBigram"):
        tokens = content_terms if model_type == "Basic" else ngram_tokens
        counts = _bounded_vocabulary(train, tokens, vocab_limit, binary=False)
        return Featurizer(tokens, PipelineModel([counts]), counts.vocabulary)
    if model_type == "InvDocFreq":
        counts = _bounded_vocabulary(train, tfidf_tokens, vocab_limit, binary=False)
        counts = counts.setOutputCol("__counts")
        frame = counts.transform(
            train.select(tfidf_tokens(F.col("text")).alias("__tokens"))
        )
        idf = IDF(inputCol="__counts", outputCol="__scaled").fit(frame)
        # MLlib's idf is ln((1+n)/(1+df)); the definition here adds one.
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense(idf.idf.toArray() + 1.0),
            inputCol="__counts",
            outputCol="__scaled",
        )
        unit = Normalizer(p=2.0, inputCol="__scaled", outputCol="features")
        return Featurizer(
            tfidf_tokens, PipelineModel([counts, scale, unit]), counts.vocabulary
        )
    if model_type not in PRESENCE_MODELS:
        raise ValueError(f"unknown model type {model_type!r}; one of {MODEL_TYPES}")

    def words(text: Column) -> Column:
        return F.array_distinct(simple_tokens(text))

    if model_type == "NLTKSingleWord":
        fitted = _bounded_vocabulary(train, words, vocab_limit, binary=True)
        return Featurizer(words, PipelineModel([fitted]), fitted.vocabulary)

    names = selected_names(top_bigrams(train), vocab_limit)
    if names is None:
        raise ValueError(f"more than {vocab_limit} bigrams are selected; raise vocab_limit")

    def bigrams(text: Column) -> Column:
        return present_bigrams(text, names)

    if model_type == "NLTKBigram":
        if not names:
            raise ValueError("no bigram reaches the minimum frequency")
        tokens, vocabulary = bigrams, names
    else:
        single = _bounded_vocabulary(train, words, vocab_limit, binary=True)
        vocabulary = single.vocabulary + names

        def tokens(text: Column) -> Column:
            return F.concat(words(text), bigrams(text))

    vectors = CountVectorizerModel.from_vocabulary(
        vocabulary, inputCol="__tokens", outputCol="features"
    ).setBinary(True)
    return Featurizer(tokens, PipelineModel([vectors]), vocabulary)


def fit_kernel_features(
    train: DataFrame, model_type: str = "Basic", vocab_limit: int = 1 << 21
) -> Featurizer | MarkedFeaturizer:
    """Features for :func:`fit_rbf_svm`: :func:`fit_features`, or, where the
    counts have more terms than ``vocab_limit``, the same counts by hashes."""
    try:
        return fit_features(train, model_type, vocab_limit)
    except VocabularyLimitError:
        if model_type not in ("Basic", "BasicBigram"):
            raise
    return MarkedFeaturizer(train, content_terms if model_type == "Basic" else ngram_tokens)


# --- classifiers ------------------------------------------------------------


def _fit(estimator, df: DataFrame):
    """Fit on cached vectors: the solver passes over them more than once, and
    each pass would tokenise the documents again."""
    vectors = df.select("features", F.col("label").cast("double").alias("label")).persist()
    try:
        return estimator.fit(vectors)
    finally:
        vectors.unpersist()


def _warn_unless_converged(steps: int, max_iter: int) -> None:
    if steps >= max_iter:
        warnings.warn(f"not converged after {max_iter} iterations", stacklevel=3)


def fit_logistic(df: DataFrame, max_iter: int = 300) -> LogisticRegressionModel:
    """Log loss with an elastic-net penalty on ``features`` and ``label``.

    Deviation: full-batch optimisation in place of stochastic steps. It runs
    until it converges; that ``max_iter`` steps were not enough is a warning.
    """
    model = _fit(
        LogisticRegression(
            elasticNetParam=0.15, regParam=1e-4, standardization=False, maxIter=max_iter
        ),
        df,
    )
    _warn_unless_converged(model.summary.totalIterations, max_iter)
    return model


_BLOCK = 256  # projection rows made together
_CELLS = 8192  # cells of documents projected together


@lru_cache(maxsize=256)
def _projection(seed: int, block: int, dim: int) -> np.ndarray:
    """Rows ``block * _BLOCK ..`` of the random projection, made on demand so
    that nothing of vocabulary size is shipped to the tasks."""
    return np.random.default_rng([seed, block]).standard_normal(
        (_BLOCK, dim), dtype=np.float32
    )


def _marked_projection(seed: int, marks: np.ndarray, dim: int) -> np.ndarray:
    """Rows of the random projection for features known by hashes: normal
    numbers from counters, so a feature has the same row in every task."""
    half = -(-dim // 2)
    with np.errstate(over="ignore"):
        x = marks.view(np.uint64) ^ (np.uint64(seed) * np.uint64(0xD1342543DE82EF95))
        x = x[:, None] + np.arange(1, 2 * half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64)
    u = (u + 0.5) / (1 << 53)
    size, turn = np.sqrt(-2 * np.log(u[:, :half])), 2 * np.pi * u[:, half:]
    return np.concatenate([size * np.cos(turn), size * np.sin(turn)], axis=1)[:, :dim].astype(np.float32)


def _projected(
    seed: int,
    dim: int,
    row: np.ndarray,
    index: np.ndarray,
    weight: np.ndarray,
    rows: int,
    names: np.ndarray | None = None,
) -> np.ndarray:
    """Weighted sums of projection rows for ``rows`` documents. Cells are read
    by block, so that a block is made once for all of them; ``row`` rises. With
    ``names``, hashes, ``index`` is a place in these."""
    out = np.zeros((rows, dim))
    if not len(index):
        return out
    block = index // _BLOCK
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.diff(block[order], prepend=-1))
    for at, end in zip(starts, [*starts[1:], len(order)], strict=True):
        number = int(block[order[at]])
        if names is None:
            made = _projection(seed, number, dim)
        else:
            made = _marked_projection(seed, names[number * _BLOCK : (number + 1) * _BLOCK], dim)
        for lo in range(at, end, _CELLS):
            mine = order[lo : min(lo + _CELLS, end)]
            terms = made[index[mine] - number * _BLOCK] * weight[mine, None]
            first = np.flatnonzero(np.diff(row[mine], prepend=-1))
            out[row[mine[first]]] += np.add.reduceat(terms, first, axis=0, dtype=np.float64)
    return out


def fourier_features(
    df: DataFrame, gamma: float, dim: int = 256, seed: int = 7, output: str = "features"
) -> DataFrame:
    """Random Fourier features (Rahimi and Recht, 2007) of ``features``:
    vectors, or the hashes of :class:`MarkedFeaturizer`.

    Inner products of the output approximate exp(-gamma * |x - y|^2).
    """
    ship_package(df.sparkSession)
    phase = np.random.default_rng([seed, 1 << 30]).uniform(0.0, 2.0 * np.pi, dim)
    width = float(np.sqrt(2.0 * gamma))
    scale = float(np.sqrt(2.0 / dim))

    @F.pandas_udf("array<double>")
    def project(indices: pd.Series, values: pd.Series) -> pd.Series:
        sizes = [len(i) for i in indices]
        flat = np.concatenate(indices.tolist()).astype(np.int64)
        weight = np.concatenate(values.tolist()).astype(np.float32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        sums = _projected(seed, dim, row, flat, weight, len(sizes))
        return pd.Series(list(scale * np.cos(phase + width * sums)))

    @F.pandas_udf("array<double>")
    def project_marks(marks: pd.Series) -> pd.Series:
        sizes = [len(m) for m in marks]
        names, code = np.unique(np.concatenate(marks.tolist()).astype(np.int64), return_inverse=True)
        cells, weight = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(names), 1) + code, return_counts=True)
        row, index = np.divmod(cells, max(len(names), 1))
        sums = _projected(seed, dim, row, index, weight.astype(np.float32), len(sizes), names)
        return pd.Series(list(scale * np.cos(phase + width * sums)))

    if isinstance(df.schema["features"].dataType, ArrayType):
        return df.withColumn(output, array_to_vector(project_marks("features")))
    raw = F.unwrap_udt("features")
    dense = raw.getField("type") == 1
    values = raw.getField("values")
    indices = F.when(
        dense, F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)))
    ).otherwise(raw.getField("indices"))
    return df.withColumn(output, array_to_vector(project(indices, values)))


class RbfSvm:
    """Linear SVM on Fourier features: an approximation of an RBF machine."""

    def __init__(self, gamma: float, dim: int, seed: int, linear):
        self._gamma, self._dim, self._seed = gamma, dim, seed
        self._linear = linear

    def transform(self, df: DataFrame) -> DataFrame:
        return self._linear.transform(
            fourier_features(df, self._gamma, self._dim, self._seed)
        )


def fit_rbf_svm(
    df: DataFrame, n_features: int, dim: int = 256, seed: int = 7, max_iter: int = 300
) -> RbfSvm:
    """``gamma`` is 1 / number of features, the usual default. The fit runs
    until it converges; that ``max_iter`` steps were not enough is a warning."""
    gamma = 1.0 / max(n_features, 1)
    mapped = fourier_features(df, gamma, dim, seed)
    linear = _fit(LinearSVC(regParam=1e-3, maxIter=max_iter), mapped)
    _warn_unless_converged(linear.summary().totalIterations, max_iter)
    return RbfSvm(gamma, dim, seed, linear)


def fit_decision_tree(df: DataFrame, max_depth: int = 30, min_rows: int = 1):
    """Decision tree by entropy on presence features; as deep as MLlib allows,
    down to single rows."""
    return _fit(
        DecisionTreeClassifier(
            impurity="entropy",
            maxDepth=max_depth,
            minInstancesPerNode=min_rows,
            maxBins=2,
            maxMemoryInMB=512,
            seed=1,
        ),
        df,
    )


def predict(model, df: DataFrame) -> DataFrame:
    """``(doc_id, label, prediction)``."""
    return model.transform(df).select(
        "doc_id", "label", F.col("prediction").cast("int").alias("prediction")
    )


def predict_proba(model, df: DataFrame) -> DataFrame:
    """``(doc_id, p0, p1)``."""
    p = vector_to_array(F.col("probability"))
    return model.transform(df).select("doc_id", p[0].alias("p0"), p[1].alias("p1"))


def coefficients(
    spark: SparkSession, model: LogisticRegressionModel, vocabulary: list[str]
) -> DataFrame:
    """``(feature, coef)`` of a fitted linear model; size is the vocabulary's."""
    return spark.createDataFrame(
        pd.DataFrame({"feature": vocabulary, "coef": model.coefficients.toArray()})
    )


def stratified_folds(
    df: DataFrame, folds: int = 10, key: str = "doc_id", hashed: Column | None = None
) -> DataFrame:
    """``(key, fold)``: positions in the order of label and key hash (``hashed``,
    or xxhash64), modulo ``folds``. The sizes of two folds differ by at most one
    row in each label. ``key`` is unique."""
    order = ["label", "__h", key]
    place = F.xxhash64(key) if hashed is None else hashed
    ranked = dist_rank(df.select(key, "label", place.alias("__h")), order)
    return ranked.select(key, ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def cross_validate_f1(
    df: DataFrame, folds: int = 10, fit=fit_logistic, parallelism: int = 4
) -> DataFrame:
    """F1 of class 1 per fold, over stratified folds.

    ``df`` has ``doc_id``, ``features``, ``label``. The logistic models are
    fitted in the same steps (``folds.held_out_predictions``). Any other ``fit``
    is a distributed job per fold over the cached vectors; ``parallelism`` of
    them run side by side. So are rows that the steps do not take: labels other
    than 0 and 1, no vector, all rows in one fold.
    """
    spark = df.sparkSession
    tagged = (
        df.select("doc_id", "features", "label")
        .join(stratified_folds(df, folds), "doc_id")
        .persist()
    )
    known = F.coalesce(F.col("label").isin(0, 1) & F.col("features").isNotNull(), F.lit(False))
    seen = tagged.agg(F.bool_and(known).alias("known"), F.min("fold") != F.max("fold")).first()
    if fit is fit_logistic and all(seen):
        try:
            rows = fold_f1(held_out_predictions(tagged, folds)).collect()
        finally:
            tagged.unpersist()
        return spark.createDataFrame(rows, "fold int, f1 double")

    def held_out(k: int) -> DataFrame:
        model = fit(tagged.filter(F.col("fold") != k))
        return predict(model, tagged.filter(F.col("fold") == k)).withColumn("fold", F.lit(k))

    try:
        with ThreadPool(parallelism) as pool:
            parts = pool.map(inheritable_thread_target(spark)(held_out), range(folds))
        # One row per fold comes back; then the cached vectors can go.
        rows = fold_f1(reduce(DataFrame.unionByName, parts)).collect()
    finally:
        tagged.unpersist()
    return spark.createDataFrame(rows, "fold int, f1 double")


def cross_validate_bayes(features: DataFrame, labels: DataFrame, folds: int = 10) -> DataFrame:
    """F1 of class 1 per fold of naive Bayes models, each fitted on the other
    folds, from one aggregate over the documents.

    ``features``: ``(doc_id, feature)``, the true ones, once each; ``labels``:
    ``(doc_id, label, fold)`` with label 0 or 1 and fold from 0. Counts are kept
    per fold; the model of a fold has the totals less the fold's own counts, so
    no document is counted twice. A feature that only its fold has is skipped.
    Scores, smoothing and ties are those of :func:`naive_bayes_predict`.
    """
    marked = features.join(labels.select("doc_id", "label", "fold"), "doc_id")
    mine = [(c, k) for c in (0, 1) for k in range(folds)]

    def tally(c: int, k: int) -> Column:
        return F.count_if((F.col("label") == c) & (F.col("fold") == k))

    def arrays(df: DataFrame, name: str) -> list[Column]:
        return [F.array(*[F.col(f"__{c}_{k}") for k in range(folds)]).alias(f"{name}{c}") for c in (0, 1)]

    counted = marked.groupBy("feature").agg(*[tally(c, k).alias(f"__{c}_{k}") for c, k in mine])
    model = counted.select("feature", *arrays(counted, "t"))
    rows = labels.agg(*[tally(c, k).alias(f"__{c}_{k}") for c, k in mine])
    sizes = rows.select(F.struct(*arrays(rows, "n")).alias("sizes")).scalar()

    def others(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
        return total - F.element_at(values, F.col("fold") + 1)

    def held(df: DataFrame) -> DataFrame:
        out = df.withColumn("__sizes", sizes)
        return out.withColumns({f"m{c}": others(F.col(f"__sizes.n{c}")) for c in (0, 1)}).drop("__sizes")

    joined = held(join_by_term(marked.select("doc_id", "fold", "feature"), model, "feature"))
    joined = joined.withColumns({f"r{c}": others(F.col(f"t{c}")) for c in (0, 1)})
    absent = (F.col("m0") + F.col("m1")) > (F.col("r0") + F.col("r1"))
    joined = joined.filter((F.col("r0") + F.col("r1")) > 0).withColumn("bins", F.when(absent, 2.0).otherwise(1.0))
    gains = joined.groupBy("doc_id").agg(
        *[
            F.sum(F.log((F.col(f"r{c}") + 0.5) / (F.col(f"m{c}") + 0.5 * F.col("bins")))).alias(f"g{c}")
            for c in (0, 1)
        ]
    )
    scored = held(labels.select("doc_id", "label", "fold").join(gains, "doc_id", "left"))
    score = [
        F.log((F.col(f"m{c}") + 0.5) / (F.col("m0") + F.col("m1") + 1.0)) + F.coalesce(f"g{c}", F.lit(0.0))
        for c in (0, 1)
    ]
    predicted = F.when(score[1] >= score[0], 1).otherwise(0).alias("prediction")
    return fold_f1(scored.select("doc_id", "label", "fold", predicted))


def cross_validate(df: DataFrame, folds: int = 10, fit=fit_logistic) -> DataFrame:
    """Mean and spread of :func:`cross_validate_f1`."""
    return cv_summary(cross_validate_f1(df, folds, fit))

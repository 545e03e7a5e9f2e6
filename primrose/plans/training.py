"""Articles and a saved split to features, models and reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from primrose.operators import logistic, metrics, models, trees
from primrose.operators.annotate import add_content_columns
from primrose.operators.corpus import corpus_stats
from primrose.operators.features import (
    bigram_presence,
    combined_features,
    labelled_features,
    presence_features,
    top_bigrams,
    word_presence,
)
from primrose.operators.ratings import add_rating_columns, min_ratings
from primrose.operators.split import select_split, split_consistency, train_test_split
from primrose.operators.validity import valid_rows
from primrose.sources import write_split_snapshot


@dataclass
class Evaluation:
    """Result frames of one classifier, by name."""

    classifier: str
    predictions: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)


def new_snapshot(articles: DataFrame, path: str, ts: str, seed: int = -42) -> None:
    """Split the usable articles and save the positions."""
    write_split_snapshot(train_test_split(valid_rows(articles), seed), path, ts)


def prepare(
    articles: DataFrame, snapshot: DataFrame, at_least: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Train and test documents ``(doc_id, text, label)``.

    Stops when the articles no longer match the saved split. Ratings are judged
    before the page text is parsed, so only rated pages are cleaned.
    """
    usable = valid_rows(articles)
    check = split_consistency(usable.select("id"), snapshot).first()
    if not check.consistent:
        raise ValueError(
            f"{check.valid_rows} usable rows but {check.saved_rows} saved: make a new split"
        )
    rated = min_ratings(add_rating_columns(usable), at_least)
    documents = add_content_columns(select_split(rated, snapshot)).select(
        F.col("id").alias("doc_id"),
        F.col("content").alias("text"),
        F.col("turk_sensitive_flag").alias("label"),
        "part",
    )
    return (
        documents.filter(F.col("part") == "train").drop("part"),
        documents.filter(F.col("part") == "test").drop("part"),
    )


def _count_models(train: DataFrame, test: DataFrame, model_type: str) -> list[Evaluation]:
    fitted = models.fit_kernel_features(train, model_type)
    vectors, held_out = fitted.transform(train, known=True), fitted.transform(test)
    labels = train.select("doc_id", "label")
    linear = logistic.fit_logistic_terms(logistic.linear_terms(train, train, model_type), labels)
    margins = logistic.margins(linear, test, logistic.linear_terms(test, train, model_type))
    kernel = models.fit_rbf_svm(vectors, fitted.size)
    judged = {
        "logistic": logistic.predictions(margins, test.select("doc_id", "label")),
        "rbf_svm": models.predict(kernel, held_out),
    }
    coefs = linear.weights.select("feature", "coef")
    out = []
    for name, pred in judged.items():
        out.append(
            Evaluation(
                name,
                pred,
                {
                    "f1": metrics.f1_score(pred),
                    "report": metrics.classification_report(pred),
                },
            )
        )
    out[0].reports |= {
        "density": metrics.coefficient_density(coefs),
        "top_terms": metrics.top_coefficients(coefs),
        "probabilities": logistic.probabilities(margins),
    }
    return out


def presence_of(docs: DataFrame, selected: DataFrame | None, model_type: str) -> DataFrame:
    """True features of ``docs`` in long form for a presence model."""
    if model_type == "NLTKSingleWord":
        return word_presence(docs)
    held = presence_features(bigram_presence(docs, selected))
    return held if model_type == "NLTKBigram" else combined_features(word_presence(docs), held)


def _presence_models(train: DataFrame, test: DataFrame, model_type: str) -> list[Evaluation]:
    selected = None if model_type == "NLTKSingleWord" else top_bigrams(train)
    labels = train.select("doc_id", "label")
    weights = models.naive_bayes_weights(
        labelled_features(presence_of(train, selected, model_type), labels), labels
    )
    # Bigram names hold a space; their absence is a value, a word's is not.
    absent = F.col("feature").contains(" ") if selected is not None else False
    bayes = models.naive_bayes_predict(
        weights, labels, test, presence_of(test, selected, model_type), absent
    ).join(test.select("doc_id", "label"), "doc_id")

    def tree_documents(docs: DataFrame) -> DataFrame:
        held = presence_of(docs, selected, model_type).filter("feature <> ''")
        arrays = held.groupBy("doc_id").agg(F.collect_set("feature").alias("features"))
        return docs.select("doc_id", "label").join(arrays, "doc_id", "left")

    held_out = tree_documents(test)
    tree = trees.fit_tree(tree_documents(train))
    grown = trees.tree_predict(tree, held_out).join(held_out.select("doc_id", "label"), "doc_id")
    return [
        Evaluation("decision_tree", grown, {"rates": metrics.precision_recall_f(grown)}),
        Evaluation(
            "naive_bayes",
            bayes,
            {
                "rates": metrics.precision_recall_f(bayes),
                "informative": metrics.informative_features(weights),
            },
        ),
    ]


def train_eval(
    articles: DataFrame, snapshot: DataFrame, model_type: str = "Basic"
) -> list[Evaluation]:
    """Both classifiers of ``model_type``, fitted on train and judged on test."""
    if model_type not in models.MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}; one of {models.MODEL_TYPES}")
    train, test = prepare(articles, snapshot)
    if model_type in models.PRESENCE_MODELS:
        return _presence_models(train, test, model_type)
    return _count_models(train, test, model_type)


def document_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """Corpus figures of both sets."""
    return (
        corpus_stats(train)
        .withColumn("documents_of", F.lit("train"))
        .unionByName(corpus_stats(test).withColumn("documents_of", F.lit("test")))
    )

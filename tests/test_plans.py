"""The flows, on a small separable corpus."""

import pytest
from pyspark.sql import functions as F

from primrose import sources
from primrose.operators import metrics, models
from primrose.plans import annotation, ingest, training
from primrose.schemas import ANNOTATION_HEADER, RATING_SLOTS

N = 160


@pytest.fixture(scope="module")
def articles(spark, tmp_path_factory):
    """Every third article is sensitive and says so; some cannot be used."""
    path = str(tmp_path_factory.mktemp("articles") / "table")
    hot = F.col("id") % 3 == 0
    (
        spark.range(N)
        .select(
            "id",
            F.concat(F.lit("http://site/"), "id").alias("link"),
            F.lit("t").alias("title"),
            F.concat(
                F.lit("<p>"),
                F.when(hot, "shocking graphic violence scene shown").otherwise(
                    "gentle garden flower picture shown"
                ),
                F.lit(" number"), F.col("id").cast("string"), F.lit("</p>"),
            ).alias("parser_content"),
            F.when(F.col("id") % 20 == 7, "None").otherwise("fine").alias("reporter_content"),
            F.when(hot, 1).otherwise(0).alias("sensitive_flag"),
            *[
                (F.when(hot, "1").otherwise("0") if i < 3 else F.lit("")).alias(c)
                for i, c in enumerate(RATING_SLOTS)
            ],
        )
        .write.parquet(path)
    )
    return sources.scan_articles(spark, path)


@pytest.fixture(scope="module")
def snapshot(spark, articles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("splits") / "saved")
    training.new_snapshot(articles.limit(50), path, "2013-12-05 16:17:00")
    training.new_snapshot(articles, path, "2013-12-07 11:41:00")
    train = sources.scan_latest_snapshot(spark, path, "train")
    return train.unionByName(sources.scan_latest_snapshot(spark, path, "test")).select("id", "part")


def accuracy(pred):
    return pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]


def test_snapshot_is_the_newest(articles, snapshot):
    usable = N - articles.filter("reporter_content = 'None'").count()
    assert snapshot.count() == usable
    assert snapshot.filter("part = 'train'").count() == usable * 3 // 4


@pytest.mark.parametrize("model_type", models.MODEL_TYPES)
def test_train_eval(articles, snapshot, model_type):
    results = training.train_eval(articles, snapshot, model_type)
    assert len(results) == 2
    size = snapshot.filter("part = 'test'").count()
    for result in results:
        assert metrics.confusion_counts(result.predictions).agg(F.sum("n")).first()[0] == size
        assert accuracy(result.predictions) > 0.9, result.classifier
        for report in result.reports.values():
            assert report.count() > 0


def test_unknown_model(articles, snapshot):
    with pytest.raises(ValueError):
        training.train_eval(articles, snapshot, "Other")


def test_stale_snapshot_stops(articles, snapshot):
    with pytest.raises(ValueError):
        training.prepare(articles, snapshot.limit(3))


def test_vocabulary_limit_is_an_error(articles, snapshot):
    train, test = training.prepare(articles, snapshot)
    with pytest.raises(ValueError):
        models.fit_features(train, "Basic", vocab_limit=3)
    assert training.document_stats(train, test).count() == 2


def test_fit_is_repeatable_and_cross_validates(articles, snapshot):
    train, _ = training.prepare(articles, snapshot)
    fitted = models.fit_features(train, "InvDocFreq")
    vectors = fitted.transform(train)
    norms = [r.features.norm(2) for r in vectors.select("features").collect()]
    assert all(abs(n - 1) < 1e-9 for n in norms)
    first, second = models.fit_logistic(vectors), models.fit_logistic(vectors)
    assert first.coefficients == second.coefficients
    scores = models.cross_validate_f1(vectors, folds=3)
    assert scores.count() == 3
    assert metrics.cv_summary(scores).first().mean_f1 > 0.9


def test_fourier_kernel(spark):
    """Inner products approximate the kernel, for dense and sparse input."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    gamma = 0.5
    points = [Vectors.dense([0.0, 1.0]), Vectors.sparse(2, [0], [1.0]), Vectors.sparse(2, [], [])]
    df = spark.createDataFrame(list(enumerate(points)), ["id", "features"])
    mapped = models.fourier_features(df, gamma, dim=4096).orderBy("id").collect()
    z = [np.array(r.features.toArray()) for r in mapped]
    for i, a in enumerate(points):
        for j, b in enumerate(points):
            exact = np.exp(-gamma * np.sum((a.toArray() - b.toArray()) ** 2))
            assert abs(z[i] @ z[j] - exact) < 0.06


def test_annotation_loop(spark, articles, tmp_path):
    batches = annotation.build_batches(articles, articles.select("id"), min_words=3)
    rows = batches.collect()
    unflagged = articles.filter("sensitive_flag = 0 AND reporter_content <> 'None'").count()
    assert len(rows) == (unflagged - 1) // 3

    answered = batches.select(
        *[
            (
                F.col("site" + name[-1]) if name.startswith("Input.site")
                else F.lit("1") if name.startswith("Answer.Q") else F.lit("v")
            ).alias(name)
            for name in ANNOTATION_HEADER
        ]
    )
    path = str(tmp_path / "results")
    answered.write.option("header", True).csv(path)
    filled, log, unknown = annotation.load_results(
        articles, sources.scan_annotation_batches(spark, path)
    )
    assert log.count() == 3 * len(rows) and unknown.count() == 0
    assert filled.filter("turk_rating3 = '1'").count() == 3 * len(rows)
    stats = annotation.analyse(filled)
    before = articles.count() * 3
    assert stats["total"].first().total_ratings == before + 3 * len(rows)
    assert stats["describe_count_turk_ratings"].first()["count"] == N


def test_new_articles(spark):
    items = spark.createDataFrame(
        [("http://a", ["adult"], 0, 1), ("http://b", None, 0, 2), ("http://a", None, 1, 3)],
        "link string, rating array<string>, feed_ord int, item_ord long")
    replies = spark.createDataFrame(
        [("http://a", '{"title":"A","content":"<p>x</p>"}')], "link string, reply string")
    stored = spark.createDataFrame([], "id long")
    got = {r.link: r for r in ingest.new_articles(items, stored, replies).collect()}
    assert (got["http://a"].reporter_content, got["http://a"].sensitive_flag) == ("x", 1)
    assert (got["http://b"].title, got["http://b"].parser_content) == ("None", "None")
    again = ingest.new_articles(items, ingest.new_articles(items, stored, replies), replies)
    assert again.count() == 0


def test_messages_to_pages(spark):
    captured = spark.createDataFrame(
        [(1, "http://t.co/abc", "en", True), (2, "http://t.co/abc", "fr", True),
         (3, "none", "en", False), (4, "http://t.co/xyz", "en", None)],
        "id long, text string, lang string, possibly_sensitive boolean")
    table = ingest.pending_messages(captured).select(
        "id", "link", "crawled", *[F.lit(None).cast("string").alias(c)
                                   for c in ("page_text", "errors", "link_actual")])
    pages = spark.createDataFrame([("http://t.co/abc", "http://a", "hi")],
                                  "link string, link_actual string, page_text string")
    rows = ingest.crawled_messages(table, pages).collect()
    assert [(r.id, r.page_text, r.crawled) for r in rows] == [(1, "hi", True)]


def test_annotation_files_are_packed_and_bounded(spark, tmp_path, monkeypatch):
    """Batch files are compressed, hold at most so many rows, and give all rows back."""
    import glob
    import os

    from primrose.plans import queries

    monkeypatch.setattr(queries, "BATCH_FILE_ROWS", 300)
    lines = spark.range(2000).selectExpr(
        "id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey",
        "'R' AS l_returnflag", "'O' AS l_linestatus", "CAST(id % 50 AS DOUBLE) AS l_quantity")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    views = queries.Views(spark, str(tmp_path))
    files = glob.glob(queries._annotation_files(views) + "/part-*")
    assert len(files) == 7 and all(f.endswith(".gz") for f in files)
    assert sum(map(os.path.getsize, files)) < 2000 * 100
    columns = ["site1", "site2", "site3", "answer1", "answer2", "answer3"]
    read = queries.QUERIES["scan_annotation_batches"](spark, str(tmp_path)).fillna("")
    assert read.exceptAll(views.grid.select(*columns)).isEmpty() and read.count() == 2000

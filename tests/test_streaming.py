"""Streams: drained, restarted on their checkpoint, equal to the batch form."""

import pytest
from pyspark.sql import functions as F

from primrose import sources, streaming
from primrose.operators import messages, ratings
from primrose.plans.queries import QUERIES
from primrose.schemas import RATING_SLOTS


def finish(stream):
    stream.awaitTermination()
    assert stream.exception() is None


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


MESSAGE = "id long, text string, lang string, possibly_sensitive boolean, source string"


def message(i, lang="en", flag=True):
    return (i, f"m{i} http://t.co/abc{i % 3}", lang, flag, "s")


def test_capture_goes_on_after_a_restart(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    add(spark, inbox, [message(1), message(2, "fr")], MESSAGE)

    def run():
        source = spark.readStream.schema(MESSAGE).parquet(inbox)
        finish(streaming.stream_capture(source, out, mark))

    run()
    run()
    assert spark.read.parquet(out).count() == 1
    add(spark, inbox, [message(3), message(4, flag=None)], MESSAGE)
    run()
    assert {r.text[:2] for r in spark.read.parquet(out).collect()} == {"m1", "m3"}


def test_bounded_capture_over_batches(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for start in (0, 10, 20):
        add(spark, inbox, [message(i) for i in range(start, start + 10)], MESSAGE)
    source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(inbox)
    finish(streaming.stream_bounded(source, out, mark, 14, ["id"]))
    assert spark.read.parquet(out).count() == 14


def test_links_equal_the_batch_form(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages = spark.createDataFrame(
        [("http://t.co/abc0", "A", "x"), ("http://t.co/abc1", "B", "{y}")],
        "link string, link_actual string, page_text string")
    for start in (0, 10):
        add(spark, inbox, [message(i) for i in range(start, start + 10)], MESSAGE)
    source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(inbox)
    for _ in range(2):
        finish(streaming.stream_links(source.select("id", "text"), pages, out, mark))
    links = messages.explode_links(spark.read.parquet(inbox).select("id", "text"))
    wanted = messages.crawl_results(links, pages)
    columns = wanted.columns
    got = spark.read.parquet(out).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_new_articles_once(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, link string, flag int, feed_ord int, item_ord long"
    add(spark, inbox, [(1, "a", 0, 0, 1), (2, "b", 1, 0, 2), (2, "b", 0, 0, 3)], schema)
    add(spark, inbox, [(2, "b", 1, 1, 4), (3, "c", 1, 1, 5)], schema)
    stored = spark.createDataFrame([(1,)], "id long")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    for _ in range(2):
        finish(streaming.stream_new_articles(source, stored, out, mark))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [2, 3]


@pytest.mark.parametrize("files", [1, 3])
def test_ratings_fill_once(spark, tmp_path, files):
    inbox, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    slots = spark.createDataFrame(
        [(1, *[""] * 5), (2, *[""] * 5)], "id long, " + ", ".join(f"{c} string" for c in RATING_SLOTS))
    sources.write_table_version(slots, table, 0)
    schema = "link_id long, rating string, file string, row_no long, pos int"
    for f in range(files):
        add(spark, inbox, [(1, str(f), f"f{f}", 0, 0), (1, str(f), f"f{f}", 1, 0)], schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    for _ in range(2):
        finish(streaming.stream_ratings(source, table, mark))
    last = spark.read.parquet(f"{table}/version={files}")
    got = ratings.count_ratings(last).orderBy("id").collect()
    assert [r.count_turk_ratings for r in got] == [min(2 * files, 5), 0]


def test_message_table_over_three_batches(spark, tmp_path):
    """Append, pending, update: a run handles the rows that came since the last."""
    inbox, table, put, got = (str(tmp_path / n) for n in ("in", "table", "put", "got"))
    pages = spark.createDataFrame(
        [("http://t.co/abc0", "A", "x"), ("http://t.co/abc1", "B", "{y}")],
        "link string, link_actual string, page_text string")
    written = 0
    for start in (0, 10, 20):
        # A repeated message is a row of its own.
        add(spark, inbox, [message(i) for i in (*range(start, start + 9), start)], MESSAGE)
        source = spark.readStream.schema(MESSAGE).parquet(inbox)
        finish(streaming.stream_appends(source, table, put))
        now = streaming.read_message_table(spark, table)
        assert now.count() == start + 10 and now.filter("not crawled").count() == 10
        assert now.filter("not crawled and page_text is not null").count() == 0
        for _ in range(2):
            finish(streaming.stream_crawl(spark, pages, table, got))
        now = streaming.read_message_table(spark, table)
        assert now.count() == start + 10 and now.filter("not crawled").count() == 0
        updates = spark.read.parquet(f"{table}/results").count()
        assert updates - written == 10
        written = updates
    links = messages.explode_links(spark.read.parquet(inbox))
    wanted = messages.crawl_results(links, pages).withColumn("crawled", F.lit(True))
    columns = sorted(wanted.columns)
    rows = streaming.read_message_table(spark, table).select(columns).collect()
    assert sorted(map(str, rows)) == sorted(map(str, wanted.select(columns).collect()))
    assert len({r.row_id for r in streaming.read_message_table(spark, table).collect()}) == 30


def test_rating_changes_equal_the_batch_form(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    names = "id long, link string, " + ", ".join(f"{c} string" for c in RATING_SLOTS)
    slots = spark.createDataFrame(
        [(1, "a", *[""] * 5), (2, "b", "7", "", None, "", "8"), (3, "c", *"12345"), (4, "d", *[""] * 5)], names)
    schema = "link_id long, rating string, file string, row_no long, pos int"
    batches = [
        [(1, "1", "f0", 0, 0), (2, "0", "f0", 1, 0), (9, "1", "f0", 2, 0)],
        [(1, "", "f1", 0, 0), (1, "0", "f1", 1, 0), (3, "1", "f1", 2, 0), (None, "1", "f1", 3, 0)],
        [(1, str(i), "f2", i, 0) for i in range(6)] + [(2, "5", "f2", 9, 0)],
    ]
    touched = [{1, 2}, {1}, {1, 2}]
    for number, rows in enumerate(batches):
        add(spark, inbox, rows, schema)
        source = spark.readStream.schema(schema).parquet(inbox)
        for _ in range(2):
            finish(streaming.stream_rating_changes(source, slots, out, mark))
        changed = spark.read.parquet(f"{out}/batch={number}")
        assert {r.id for r in changed.collect()} == touched[number]
    got = streaming.rated_articles(slots, spark.read.parquet(out)).select(slots.columns)
    wanted = ratings.fill_rating_slots(slots, spark.read.schema(schema).parquet(inbox))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_a_repeated_rating_batch_changes_nothing(spark, tmp_path):
    """The commit of the last batch is lost: the batch runs again."""
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    slots = spark.createDataFrame(
        [(1, *[""] * 5)], "id long, " + ", ".join(f"{c} string" for c in RATING_SLOTS))
    schema = "link_id long, rating string, file string, row_no long, pos int"
    seen = []
    for file in ("f0", "f1"):
        add(spark, inbox, [(1, file, file, 0, 0)], schema)
        source = spark.readStream.schema(schema).parquet(inbox)
        finish(streaming.stream_rating_changes(source, slots, out, mark))
    for _ in range(2):
        seen.append(streaming.rated_articles(slots, spark.read.parquet(out)).first())
        for name in ("1", ".1.crc"):
            (tmp_path / "mark" / "commits" / name).unlink(missing_ok=True)
        finish(streaming.stream_rating_changes(source, slots, out, mark))
    seen.append(streaming.rated_articles(slots, spark.read.parquet(out)).first())
    assert seen[0] == seen[1] == seen[2] and seen[0][:4] == (1, "f0", "f1", "")


@pytest.mark.parametrize("as_folder", [False, True])
def test_new_articles_of_a_table_in_one_file_or_many(spark, tmp_path, as_folder):
    """A table may be one parquet file or a folder of them."""
    pages = [(1, "http://a.org/1?x", ""), (2, "https://a.org/2", ""), (3, "http://a.org/3#y", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    if as_folder:
        df.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    else:
        df.toPandas().to_parquet(tmp_path / "pages.parquet")
    found = QUERIES["stream_new_articles"](spark, str(tmp_path))
    assert sorted((r.link, r.flag) for r in found.collect()) == [("http://a.org/1?x", 1), ("http://a.org/3#y", 0)]

"""Edge cases on tiny frames."""

import datetime
import html
import math
from collections import defaultdict

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from primrose import functions as fn
from primrose import sources
from primrose.functions.stopwords import STOP_WORDS
from primrose.functions.text import none_to_null
from primrose.operators import (
    annotate,
    corpus,
    features,
    feeds,
    messages,
    metrics,
    models,
    rank,
    ratings,
    split,
    validity,
)
from primrose.schemas import ANNOTATION_HEADER, RATING_SLOTS


def one(spark, expr, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expr(F.col("x")).alias("y")).first().y


def test_stop_words_are_sparks(spark):
    assert STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize(
    ("text", "links"),
    [
        ("see http://a.co/xy. and https://b.org/p?q=1", ["http://a.co/xy", "https://b.org/p"]),
        ("https://spam-farm.example", []),  # cut at '-', then too short
        ("http://abcde", []),
        ("http://abcdef", ["http://abcdef"]),
        ("http://t.co/1x http://t.co/1x", ["http://t.co/1x", "http://t.co/1x"]),
        ("no link", []),
    ],
)
def test_extract_links(spark, text, links):
    assert one(spark, fn.extract_links, text) == links


def test_split_link_id(spark):
    assert one(spark, fn.split_link, "http://a#b#7") == "http://a"
    assert one(spark, fn.split_link_key, "http://a#b#7") == "b#7"
    assert one(spark, fn.split_link, "http://a") == "http://a"
    assert one(spark, fn.split_link_key, "http://a") is None
    assert one(spark, fn.split_link_key, "http://a#-12") == "-12"


@pytest.mark.parametrize(("text", "n"), [("", 1), ("a  b", 3), ("a b", 2)])
def test_word_count(spark, text, n):
    assert one(spark, fn.word_count, text) == n


def test_simple_tokens_keep_blanks(spark):
    assert one(spark, fn.simple_tokens, "It's é, ok") == ["it", "s", "", "", "", "ok"]


def test_word_tokens_drop_punctuation_substrings(spark):
    # '()' and '...' are runs: the first occurs in the punctuation string.
    assert one(spark, fn.word_tokens, "Hey, you() ... ok!") == ["hey", "you", "...", "ok"]


def test_html_to_text(spark):
    html = (
        "<!DOCTYPE html><p> A&amp;lt;b\n<script>var x='</p>';</script>"
        "<style>p{}</style><!-- c -->C&nbsp;d </p>"
    )
    assert one(spark, fn.html_to_text, html) == "A&lt;b C\u00a0d"


def test_entities(spark):
    text = (
        "a&rsquo;b&#8217;c&#x2019;d&hellip;&amp;&notin;&Aacute;&#146;&#128512; &nosuch; &amp;lt; R&D; a & b&"
        "&#xD800;&#0;&NotEqualTilde;"
    )
    assert one(spark, fn.html_to_text, text) == html.unescape(text)
    assert one(spark, fn.html_to_text, "plain; text") == "plain; text"
    assert one(spark, fn.html_to_text, None) is None


def test_clip80(spark):
    assert one(spark, fn.clip80, "x" * 80) == "x" * 80
    assert one(spark, fn.clip80, "x" * 81) == "x" * 77 + "..."


def test_none_to_null(spark):
    assert one(spark, none_to_null, "None") is None
    assert one(spark, none_to_null, "x") == "x"


def test_snapshot_time(spark):
    got = one(spark, fn.parse_snapshot_time, "train_@12-07-2013_11-41.pk1")
    assert got == datetime.datetime(2013, 12, 7, 11, 41)
    assert one(spark, fn.parse_snapshot_time, ".placeholder") is None


@pytest.mark.parametrize(
    ("avg", "label", "bin_"),
    [
        (None, 0, None), (0.0, 0, None), (0.25, 0, "(0, 0.25]"), (0.5, 1, "(0.25, 0.5]"),
        (0.51, 1, "(0.5, 0.75]"), (1.0, 1, "(0.75, 1]"),
    ],
)
def test_label_and_bin(spark, avg, label, bin_):
    assert one(spark, fn.sensitive_label, avg, "double") == label
    assert one(spark, fn.rating_bin, avg, "double") == bin_


def test_term_counts(spark):
    counts = one(spark, fn.term_counts, ["b", "a", "b"], "array<string>")
    assert {(c.term, c.n) for c in counts} == {("a", 1), ("b", 2)}
    assert one(spark, fn.term_counts, [], "array<string>") == []


def test_bigrams_of_short_texts(spark):
    assert one(spark, fn.adjacent_bigrams, ["a"], "array<string>") == []
    assert one(spark, fn.adjacent_bigrams, [], "array<string>") == []
    assert one(spark, fn.ngram_tokens, "red fox jumps") == [
        "red", "fox", "jumps", "red fox", "fox jumps",
    ]


# --- positions --------------------------------------------------------------


def test_rank_is_exact_under_skew(spark):
    """One key holds most rows; ranks and running sums stay exact."""
    rows = [(i, "hot" if i % 5 else f"k{i % 3}", i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, v long").repartition(7)
    got = {r.id: r.rank for r in rank.dist_rank(df, ["k", "id"]).collect()}
    expected = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert got == expected

    sums = rank.dist_running_sum(df, ["k"], ["id"], {"run": "v", "n": F.lit(1)})
    run, n = defaultdict(int), defaultdict(int)
    wanted = {}
    for i, k, v in rows:
        run[k] += v
        n[k] += 1
        wanted[i] = (run[k], n[k])
    assert {r.id: (r.run, r.n) for r in sums.collect()} == wanted


def test_running_sum_with_many_keys(spark):
    rows = [(i, i % 300, 1) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k long, v long")
    got = rank.dist_running_sum(df, ["k"], ["id"], {"run": "v"}).collect()
    assert {r.id: r.run for r in got} == {i: i // 300 + 1 for i, _, _ in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 101, 1000])
def test_split_sizes(spark, n):
    parts = split.train_test_split(spark.range(n)).collect()
    train = {r.id for r in parts if r.part == "train"}
    assert len(train) == math.floor(0.75 * n)
    assert {r.id for r in parts} == set(range(n))
    again = split.train_test_split(spark.range(n).repartition(3)).collect()
    assert {r.id for r in again if r.part == "train"} == train


def test_split_consistency(spark):
    parts = split.train_test_split(spark.range(8))
    assert split.split_consistency(spark.range(8), parts).first().consistent
    assert not split.split_consistency(spark.range(9), parts).first().consistent


def test_latest_snapshot_tie(spark):
    names = ["b_@12-07-2013_11-41.x", "a_@12-07-2013_11-41.x", "z_@12-05-2013_16-17.x", ".DS_Store"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert split.latest_snapshot(df).first().name == "a_@12-07-2013_11-41.x"


# --- ratings ----------------------------------------------------------------


def slots(spark, *values):
    return spark.createDataFrame(
        [(i, *v) for i, v in enumerate(values, 1)],
        "id long, " + ", ".join(f"{c} string" for c in RATING_SLOTS),
    )


def incoming(spark, rows):
    return spark.createDataFrame(
        rows, "link_id long, rating string, file string, row_no long, pos int"
    )


def test_six_ratings_into_five_slots(spark):
    articles = slots(spark, ("", "9", "", "", ""), ("",) * 5)
    given = incoming(spark, [(1, str(k), "f", k, 0) for k in range(6)] + [(3, "1", "f", 9, 0)])
    filled = ratings.fill_rating_slots(articles, given).orderBy("id").collect()
    assert tuple(filled[0])[1:] == ("0", "9", "1", "2", "3")
    assert tuple(filled[1])[1:] == ("",) * 5
    log = ratings.rating_audit_log(ratings.assign_slots(articles, given)).collect()
    assert {(r.rating, r.column) for r in log} == {
        ("0", "turk_rating0"), ("1", "turk_rating2"), ("2", "turk_rating3"), ("3", "turk_rating4"),
    }
    assert ratings.unmatched_ratings(given, articles).first().link_id == 3


def test_rating_columns(spark):
    got = ratings.add_rating_columns(
        slots(spark, ("",) * 5, ("1", "0", "", "", ""), ("1", "1", "1", "0", "1"))
    ).orderBy("id").collect()
    assert [r.count_turk_ratings for r in got] == [0, 2, 5]
    assert [r.avg_turk_ratings for r in got] == [None, 0.5, 0.8]
    assert [r.turk_sensitive_flag for r in got] == [0, 1, 1]
    linked = spark.createDataFrame([("a", 0.5, 5), ("b", 0.6, 5), ("c", 0.9, 4)],
                                   "link string, avg_turk_ratings double, count_turk_ratings int")
    assert [r.link for r in ratings.agreed_sensitive(linked).collect()] == ["b"]


def test_describe_small(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)] + [(None,)], "x double")
    r = ratings.describe_column(df, "x").first()
    assert (r["count"], r.mean, r.min, r.p25, r.p50, r.p75, r.max) == (4, 2.5, 1, 1.75, 2.5, 3.25, 4)


# --- annotation -------------------------------------------------------------


@pytest.mark.parametrize(("n", "kept", "all_"), [(0, 0, 0), (2, 0, 1), (3, 0, 1), (4, 1, 2), (7, 2, 3)])
def test_annotation_batches(spark, n, kept, all_):
    df = spark.range(n).withColumn("link", F.lit("u"))
    assert annotate.annotation_batches(df).count() == kept
    rows = annotate.annotation_batches(df, drop_last=False).collect()
    assert len(rows) == all_
    links = sorted(x for r in rows for x in (r.site1, r.site2, r.site3) if x)
    assert links == sorted(f"u#{i}" for i in range(n))


def test_partial_label_counts_keep_last_link(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "link_id long, link string, ord long")
    got = {tuple(r) for r in annotate.partial_label_counts(df).collect()}
    assert got == {(1, 2, "b"), (2, 1, "c")}


# --- feeds ------------------------------------------------------------------


def test_first_feed_and_last_entry(spark):
    items = spark.createDataFrame(
        [(1, 0, 1, "l", 0), (1, 0, 2, "l", 1), (1, 1, 3, "l", 0), (2, 1, 4, "m", 1)],
        "id long, feed_ord int, item_ord long, link string, flag int",
    )
    got = {r.id: (r.feed_ord, r.flag) for r in feeds.first_feed_wins(items).collect()}
    assert got == {1: (0, 1), 2: (1, 1)}


def test_doubly_stored_is_not_stored(spark):
    items = spark.range(3)
    stored = spark.createDataFrame([(0,), (1,), (1,)], "id long")
    status = {r.id: r.in_db for r in feeds.stored_status(items, stored).collect()}
    assert status == {0: True, 1: False, 2: False}
    assert [r.id for r in feeds.new_items(items, stored).collect()] == [2]


def test_adult_flag(spark):
    items = spark.createDataFrame(
        [(["adult"],), (["nonadult"],), (None,), ([],)], "rating array<string>"
    )
    assert [r.flag for r in feeds.adult_flag(items).collect()] == [1, 0, 0, 0]


def test_reply_merging(spark):
    items = spark.createDataFrame([(1, "old"), (2, "old")], "id long, title string")
    replies = spark.createDataFrame([(1, '{"title":"new"}'), (2, '{"content":"c"}')], "id long, reply string")
    merged = feeds.merge_api_record(items, feeds.parse_reply(replies))
    filled = feeds.fill_none(merged.withColumn("reporter_content", F.col("content")))
    got = {r.id: (r.title, r.content, r.reporter_content) for r in filled.collect()}
    assert got == {1: ("new", "None", "None"), 2: ("old", "c", "c")}


# --- messages and validity --------------------------------------------------


def test_raw_rule_keeps_explicit_null(spark):
    raw = spark.createDataFrame(
        [('{"lang":"en","possibly_sensitive":null}',), ('{"lang":"en"}',),
         ('{"lang":"fr","possibly_sensitive":true}',)], "value string")
    assert messages.filter_raw_messages(raw).count() == 1


def test_crawl_outcome(spark):
    links = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, link string")
    pages = spark.createDataFrame(
        [("a", "A", "text"), ("b", "B", "x {y}"), ("c", "C", "")],
        "link string, link_actual string, page_text string")
    got = {r.id: (r.page_text, r.errors, r.link_actual)
           for r in messages.crawl_results(links, pages).collect()}
    assert got == {
        1: ("text", "None", "A"), 2: ("None", "None", "B"), 3: ("None", "None", "C"),
        4: ("None", "error visiting", "None"),
    }


def test_validity(spark):
    df = spark.createDataFrame(
        [(1, None, 0), (2, "None", 1), (3, "x Thanks for Registering!", 1),
         (4, "x Thanks for Registering!", 0), (5, "ok", 1)],
        "id long, reporter_content string, sensitive_flag int")
    reasons = {r.id: r.reason for r in validity.classify_validity(df).collect()}
    assert reasons == {1: "null", 2: "none", 3: "registration_wall", 4: "registration_wall", 5: "ok"}
    assert {r.id for r in validity.candidates_by_flag(df).collect()} == {1, 4, 5}
    assert {r.id for r in validity.drop_registration_wall(df).collect()} == {1, 2, 5}


# --- features and metrics ---------------------------------------------------

DOCS = [
    (1, "the nasty words here, nasty words again and nasty words more", 1),
    (2, "calm river calm river calm river calm river", 0),
    (3, "nothing else; nasty words", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, label int")


def test_tfidf_norms(docs):
    norms = features.tfidf_terms(docs).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in norms.collect())


def test_probabilities_sum_to_one(docs):
    probs = features.label_bigram_probs(features.label_bigram_counts(docs))
    sums = probs.groupBy("label").agg(F.sum("prob").alias("s")).collect()
    assert len(sums) == 2 and all(abs(r.s - 1) < 1e-9 for r in sums)


def test_top_bigrams_by_hand(docs):
    counts = {0: defaultdict(int), 1: defaultdict(int)}
    for _, text, label in DOCS:
        words = [w for w in text.replace(",", "").replace(";", "").split(" ")]
        for a, b in zip(words, words[1:]):
            if len(a) > 3 or len(b) > 3:
                counts[label][a, b] += 1
    size = {k: sum(v.values()) for k, v in counts.items()}
    expected = sorted(
        (
            (abs(counts[1][b] / size[1] - counts[0][b] / size[0]), b)
            for b in set(counts[0]) | set(counts[1])
            if counts[0][b] >= 3 or counts[1][b] >= 3
        ),
        reverse=True,
    )
    got = [(r.diff, (r.w1, r.w2)) for r in features.top_bigrams(docs).collect()]
    assert [b for _, b in got] == [b for _, b in expected]
    assert all(abs(x[0] - y[0]) < 1e-12 for x, y in zip(got, expected))


def test_presence_by_join_and_in_the_row_agree(docs):
    chosen = features.top_bigrams(docs)
    joined = features.bigram_presence(docs, chosen)
    within = features.present_bigrams(F.col("text"), features.selected_names(chosen))
    inline = docs.select("doc_id", F.sort_array(within).alias("present"))
    as_map = lambda df: {r.doc_id: r.present for r in df.collect()}
    assert as_map(inline) == as_map(joined)
    names = features.selected_names(chosen)
    flags = {r.doc_id: r.features for r in features.presence_map(inline, names).collect()}
    assert flags[2]["calm river"] and not flags[2]["nasty words"]
    assert set(flags[1]) == set(names)


def test_corpus_stats_by_hand(docs):
    tokens = [t for _, text, _ in DOCS for t in
              "".join(c if c.isalnum() else " " for c in text).lower().split(" ")]
    r = corpus.corpus_stats(docs).first()
    assert (r.documents, r.words, r.vocabulary) == (3, len(tokens), len(set(tokens)))
    assert corpus.vocabulary(docs).count() == len(set(tokens))


def test_naive_bayes_by_hand(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, label int")
    feats = spark.createDataFrame(
        [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (1, "c"), (2, "c"), (3, "c")],
        "doc_id long, feature string")
    weights = models.naive_bayes_weights(features.labelled_features(feats, labels), labels)
    got = {(r.label, r.feature, r.value): r.prob for r in
           models.naive_bayes_table(features.labelled_features(feats, labels), labels).collect()}
    assert got[1, "a", "true"] == 2.5 / 3 and got[0, "a", "true"] == 0.5 / 2
    assert got[0, "a", "absent"] == 1.5 / 2
    assert got[1, "c", "true"] == 2.5 / 2.5 and (1, "c", "absent") not in got
    test = spark.createDataFrame([(9,), (10,)], "doc_id long")
    seen = spark.createDataFrame([(9, "a"), (9, "unknown")], "doc_id long, feature string")
    scores = {r.doc_id: r for r in models.naive_bayes_predict(weights, labels, test, seen).collect()}
    assert abs(scores[9].score1 - (math.log(2.5 / 4) + math.log(2.5 / 3))) < 1e-12
    assert abs(scores[10].score0 - math.log(1.5 / 4)) < 1e-12
    fixed = {r.doc_id: r for r in models.naive_bayes_predict(weights, labels, test, seen, True).collect()}
    by_hand = math.log(1.5 / 4) + math.log(got[0, "a", "true"]) + math.log(got[0, "b", "absent"]) + math.log(0.5 / 1.5)
    assert abs(fixed[9].score0 - by_hand) < 1e-12


def test_undefined_rates(spark):
    pred = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    rates = {r["class"]: r for r in metrics.precision_recall_f(pred).collect()}
    assert rates[1].precision is None and rates[1].recall == 0 and rates[1].f_measure is None
    assert rates[0].precision == 0.5 and rates[0].recall == 1
    assert metrics.f1_score(pred).first().f1 == 0
    assert metrics.confusion_counts(pred).agg(F.sum("n")).first()[0] == 2


def test_top_coefficients(spark):
    coefs = spark.createDataFrame([(f"f{i:02d}", float(i)) for i in range(40)], "feature string, coef double")
    rows = metrics.top_coefficients(coefs).orderBy("place").collect()
    assert [r.feature for r in rows[:2]] == ["f39", "f38"] and rows[29].band == 3 and len(rows) == 30
    assert metrics.coefficient_density(coefs).first().density == 39 / 40


# --- files ------------------------------------------------------------------


def test_message_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('[{"text":"x","lang":"en","source":"s","possibly_sensitive":true}]')
    (tmp_path / "sub" / "b.json").write_text('[\n {"text":"y"},\n {"text":"z"}\n]')
    (tmp_path / "note.txt").write_text("skip")
    assert {r.text for r in sources.scan_message_json(spark, str(tmp_path)).collect()} == {"x", "y", "z"}


def test_feed_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><link>http://a</link>'
        "<media:rating>nonadult</media:rating><media:rating>adult</media:rating></item>"
        "<item><link>http://b</link></item></channel></rss>")
    rows = {r.link: r.rating for r in sources.scan_feed_items(spark, str(tmp_path)).collect()}
    assert rows == {"http://a": ["nonadult", "adult"], "http://b": None}


def test_annotation_file_with_bare_carriage_returns(spark, tmp_path):
    def line(site, answer):
        cells = dict.fromkeys(ANNOTATION_HEADER, "v")
        cells |= {f"Input.site{i}": f"http://{site}{i}#{i}" for i in (1, 2, 3)}
        cells |= {f"Answer.Q{i}": answer for i in (1, 2, 3)}
        return ",".join(cells.values())

    body = "\r".join([",".join(ANNOTATION_HEADER), line("a", "1"), line("b", "0")])
    (tmp_path / "batch.csv").write_bytes(body.encode())
    read = sources.scan_annotation_batches(spark, str(tmp_path))
    pairs = ratings.parse_ratings(ratings.unpivot_ratings(read)).orderBy("row_no", "pos").collect()
    assert [(r.link, r.link_id, r.rating) for r in pairs] == [
        (f"http://{s}{i}", i, a) for s, a in (("a", "1"), ("b", "0")) for i in (1, 2, 3)
    ]
    assert {r.file for r in pairs} == {"batch.csv"}


def test_id_grid_is_ragged(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("-1,2\n3\n")
    assert {r.id for r in sources.scan_id_grid(spark, str(tmp_path)).collect()} == {"-1", "2", "3"}


def test_bad_messages_are_set_aside(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "t", "l", "true"), (2, "t", "l", "what"), (3, None, "l", "true")],
        "id long, text string, link string, possibly_sensitive string")
    table = str(tmp_path / "t")
    sources.append_messages(rows, table)
    sources.append_messages(rows.filter("id = 1"), table)
    assert [r.id for r in sources.scan_messages(spark, table).collect()] == [1, 1]
    assert spark.read.json(f"{table}_rejects").count() == 2


def test_small_tables_are_spread(spark):
    assert sources.spread_small(spark.range(10), "id").rdd.getNumPartitions() == 4


def test_blank_ratings_take_no_slot(spark):
    from primrose.operators.ratings import assign_slots, fill_rating_slots

    articles = spark.createDataFrame([(1, "", "", "", "", "")], ["id", *[f"turk_rating{i}" for i in range(5)]])
    given = ["", "", None, "", " ", "1"]
    ratings = spark.createDataFrame([(1, r, "f", i) for i, r in enumerate(given)], "link_id long, rating string, file string, row_no int")
    order = ["file", "row_no"]
    assert fill_rating_slots(articles, ratings, order).first().turk_rating0 == "1"
    stored = assign_slots(articles, ratings, order).collect()
    assert [(r.rating, r.slot) for r in stored] == [("1", 0)]


def test_common_term_is_dealt_over_tasks(spark):
    from primrose.operators.features import join_by_term

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("every").alias("term"))
    model = spark.createDataFrame([("every", 2.0), ("never", 1.0)], "term string, w double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_by_term(rows, model.groupBy("term").agg(F.sum("w").alias("w")))
        assert joined.filter("w = 2").count() == 4000
        held = rows.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(16))).groupBy("s").count()
        assert held.agg(F.max("count")).first()[0] < 4000 / 16 * 1.4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stratified_folds(spark):
    rows = spark.range(103).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, 1.0).otherwise(0.0).alias("label")
    )
    sizes = rows.join(models.stratified_folds(rows), "doc_id").groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 10 and max(counts) - min(counts) <= 1


def test_fits_run_to_convergence(spark):
    """No warning at the default bound; one where a bound ends a fit."""
    import random
    import warnings

    from pyspark.ml.linalg import Vectors

    rng = random.Random(2)
    rows = []
    for _ in range(120):
        x = [rng.gauss(0, 1) * (1 + j) for j in range(30)]
        rows.append((Vectors.dense(x), int(x[0] + x[1] + rng.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert models.fit_logistic(df).summary.totalIterations > 20
        models.fit_rbf_svm(df, 30, dim=16)
    with pytest.warns(UserWarning, match="not converged after 1 iterations"):
        models.fit_rbf_svm(df, 30, dim=16, max_iter=1)


def test_only_common_terms_are_dealt(spark, monkeypatch):
    """One term stands in every document: no task has more than a share of it,
    and a rare term has one model row."""
    from primrose.operators import features

    monkeypatch.setattr(features, "COMMON_SHARE", 16)
    monkeypatch.setattr(features, "COMMON_ROWS", 10)
    rows = spark.range(400).select(
        F.col("id").alias("doc_id"),
        F.explode(F.array(F.lit("the"), F.concat(F.lit("t"), F.col("id").cast("string")))).alias("term"),
    )
    model = features.document_frequencies(rows)
    found = features.join_by_term(rows, model, count="df")
    assert found.columns == ["term", "doc_id", "df"] and found.count() == 800
    assert found.filter("df <> if(term = 'the', 400, 1)").count() == 0
    # 800 rows in 16 shares of 50: the common term is dealt over eight tasks.
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        the = features.join_by_term(rows, model, count="df").filter("term = 'the'")
        tasks = the.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 400
    assert 5 <= len(tasks) <= 8 and max(r["count"] for r in tasks) <= 200
    # Counts that are missing or too small lose nothing.
    odd = model.withColumn("df", F.when(F.col("term") == "the", F.lit(None).cast("long")).otherwise(0))
    assert features.join_by_term(rows, odd, count="df").count() == 800
    assert features.join_by_term(rows, model.limit(0), count="df").count() == 0

"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from primrose import sources, streaming
from primrose.functions import (
    bigram_length_filter as longer_word,
    clip80 as clip80_of,
    compose_link_id as composed,
    extract_links as links_of,
    html_to_text as text_of_html,
    link_key as key_of_link,
    parse_snapshot_time as time_in_name,
    rating_bin as bin_of,
    sensitive_label as label_of,
    simple_tokens as tokens_of,
    split_link,
    split_link_key,
    stamp_name as stamp_of,
    word_count as words_in,
    word_tokens as words_of,
)
from primrose.functions.names import FEED_STAMP
from primrose.operators import (
    annotate,
    corpus,
    features,
    feeds,
    logistic,
    messages,
    metrics,
    models,
    ratings,
    split,
    trees,
    validity,
)
from primrose.operators.rank import dist_rank
from primrose.plans.views import MESSAGE_COLS, RATING_COLS, RATING_ORDER, Views
from primrose.schemas import ANNOTATION_RESULT, ARTICLES, conform
from primrose.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHUNK_LIMIT = 4096  # small, so that several chunks appear
CAPTURE_CAP = 500
FEED_FILE_ITEMS = 500
BATCH_FILE_ROWS = 1_000_000
SNAPSHOT_TIMES = ("2013-12-05 16:17:00", "2013-12-07 11:41:00")


def query(fn: Callable[[Views], DataFrame]) -> Query:
    """Register ``fn`` under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Views(spark, folder))

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return run


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or str(c))


# --- sources ----------------------------------------------------------------


@query
def scan_articles(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "articles")
    conform(v.articles, ARTICLES).write.parquet(path)
    return sources.scan_articles(v.spark, path)


@query
def scan_message_json(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "captures")
    kept = messages.project_messages(messages.filter_messages(v.messages))
    ordered = messages.filter_messages(v.messages).select("id", *kept.columns)
    sources.write_capture_files(ordered, path, ["id"])
    return sources.scan_message_json(v.spark, path, "*")


@query
def scan_feed_items(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "feeds")
    tags = F.transform(
        F.coalesce("rating", F.array().cast("array<string>")),
        lambda r: F.concat(F.lit("<media:rating>"), r, F.lit("</media:rating>")),
    )
    item = F.concat(
        F.lit("<item><link>"), F.replace(F.col("link"), F.lit("&"), F.lit("&amp;")),
        F.lit("</link>"), F.array_join(tags, ""), F.lit("</item>"),
    )
    entries = v.feed_listing(v.table("pages")).select("item_ord", item.alias("item"))
    filed = dist_rank(entries, ["item_ord"]).withColumn(
        "file_no", F.floor((F.col("rank") - 1) / FEED_FILE_ITEMS)
    )
    (
        filed.groupBy("file_no")
        .agg(F.array_join(F.collect_list("item"), "").alias("body"))
        .select(
            "file_no",
            F.concat(
                F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>'),
                "body", F.lit("</channel></rss>"),
            ).alias("value"),
        )
        .write.partitionBy("file_no").text(path)
    )
    items = sources.scan_feed_items(v.spark, path)
    return items.select("link", F.array_join("rating", ",").alias("ratings"))


def _annotation_files(v: Views) -> str:
    path = scratch_path(v.spark, "batches")
    cells = {
        "Input.site1": "site1", "Input.site2": "site2", "Input.site3": "site3",
        "Answer.Q1": "answer1", "Answer.Q2": "answer2", "Answer.Q3": "answer3",
    }
    columns = [
        F.col(cells[f.name]).alias(f.name) if f.name in cells
        else F.lit(f.name.lower()).alias(f.name)
        for f in ANNOTATION_RESULT.fields
    ]
    # Most cells of a batch file repeat from row to row. A compressed file is
    # read by one task, so its rows are bounded.
    packed = {"header": True, "compression": "gzip", "maxRecordsPerFile": BATCH_FILE_ROWS}
    v.grid.select(*columns).write.options(**packed).csv(path)
    return path


@query
def scan_annotation_batches(v: Views) -> DataFrame:
    read = sources.scan_annotation_batches(v.spark, _annotation_files(v))
    return read.select(
        *[
            F.col(f"`{kind}{i}`").alias(f"{name}{i}")
            for kind, name in (("Input.site", "site"), ("Answer.Q", "answer"))
            for i in (1, 2, 3)
        ]
    )


@query
def scan_id_grid(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "ids")
    v.table("lineitem").select("l_orderkey", "l_partkey").write.csv(path)
    ids = sources.scan_id_grid(v.spark, path)
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _split(v: Views) -> DataFrame:
    return split.train_test_split(validity.valid_rows(v.articles))


@query
def scan_latest_snapshot(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "snapshots")
    saved = _split(v)
    sources.write_split_snapshot(saved.filter(F.col("part") == "test"), path, SNAPSHOT_TIMES[0])
    sources.write_split_snapshot(saved, path, SNAPSHOT_TIMES[1])
    return sources.scan_latest_snapshot(v.spark, path, "train").select("id")


# --- sinks (written, then read back) ----------------------------------------


@query
def write_messages_json(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "messages")
    sources.write_messages_json(
        messages.project_messages(messages.filter_messages(v.messages)), path
    )
    return v.spark.read.schema(
        "text string, possibly_sensitive boolean, source string, lang string"
    ).json(path)


def _sized(v: Views) -> DataFrame:
    return v.table("documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("filename"),
        F.octet_length("text").alias("size"),
    )


@query
def write_chunked_json(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "chunks")
    docs = v.table("documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("filename"),
        F.col("text").alias("page_text"),
    )
    sources.write_chunked_json(docs, path, "id", CHUNK_LIMIT * 64)
    back = v.spark.read.schema(
        "id long, page_text string, filename string, chunk long"
    ).json(path)
    return back.select("id", "filename", "chunk", F.octet_length("page_text").alias("size"))


@query
def append_messages(v: Views) -> DataFrame:
    table = scratch_path(v.spark, "message-table")
    rows = messages.explode_links(v.messages).withColumn(
        "possibly_sensitive",
        F.when(F.col("lang") == "fr", "unknown").otherwise(
            F.col("possibly_sensitive").cast("string")
        ),
    )
    sources.append_messages(rows, table)
    stored = sources.scan_messages(v.spark, table)
    return stored.select("id", "lang", "source", "link", "possibly_sensitive", "crawled")


@query
def insert_new_articles(v: Views) -> DataFrame:
    table = scratch_path(v.spark, "article-table")
    sources.insert_new_articles(v.stored.distinct(), table)
    fresh = feeds.first_feed_wins(v.feed_items).withColumnRenamed("flag", "sensitive_flag")
    sources.insert_new_articles(fresh, table)
    return sources.scan_articles(v.spark, table).select("id", "link", "sensitive_flag")


@query
def merge_crawl_results(v: Views) -> DataFrame:
    results = messages.crawl_results(messages.pending_links(v.links), v.fetched)
    return messages.merge_crawl_results(v.links, results).select(
        "id", "link", "crawled", "errors", "link_actual", "page_text"
    )


def _unflagged(v: Views) -> DataFrame:
    return v.articles.filter(F.col("sensitive_flag") == 0).select("id", "link")


@query
def write_annotation_csv(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "annotation")
    sources.write_annotation_csv(annotate.annotation_batches(_unflagged(v)), path)
    return v.spark.read.option("header", True).schema(
        "site1 string, site2 string, site3 string"
    ).csv(path)


@query
def write_link_flags_csv(v: Views) -> DataFrame:
    path = f"{scratch_path(v.spark, 'flags')}"
    sources.write_link_flags_csv(feeds.first_feed_wins(v.feed_items), path)
    return v.spark.read.option("header", True).option("quote", "|").schema(
        "link string, flag int"
    ).csv(path)


@query
def write_split_snapshot(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "split")
    sources.write_split_snapshot(_split(v), path, SNAPSHOT_TIMES[1])
    back = v.spark.read.parquet(path)
    return back.select(
        "id", "part", stamp_of(F.col("snapshot_ts").cast("timestamp")).alias("stamp")
    )


@query
def rating_audit_log(v: Views) -> DataFrame:
    return ratings.rating_audit_log(
        ratings.assign_slots(v.slots, v.ratings, RATING_ORDER)
    )


# --- projections and filters ------------------------------------------------


@query
def filter_messages(v: Views) -> DataFrame:
    return messages.filter_messages(v.messages).select("id", "lang", "possibly_sensitive")


@query
def filter_raw_messages(v: Views) -> DataFrame:
    raw = v.messages.select(
        "id",
        F.to_json(
            F.struct("lang", "possibly_sensitive"), {"ignoreNullFields": "false"}
        ).alias("value"),
    )
    return messages.filter_raw_messages(raw).select("id")


@query
def project_messages(v: Views) -> DataFrame:
    return messages.project_messages(v.messages)


@query
def pending_links(v: Views) -> DataFrame:
    return messages.pending_links(v.links)


@query
def classify_validity(v: Views) -> DataFrame:
    return validity.classify_validity(v.articles).select("id", "reason")


@query
def valid_rows(v: Views) -> DataFrame:
    return validity.valid_rows(v.articles).select("id", "reporter_content")


@query
def problem_report(v: Views) -> DataFrame:
    return validity.problem_report(v.articles)


@query
def drop_registration_wall(v: Views) -> DataFrame:
    return validity.drop_registration_wall(v.articles).select("id")


@query
def candidates_by_flag(v: Views) -> DataFrame:
    return validity.candidates_by_flag(v.articles).select("id", "sensitive_flag")


@query
def sensitive_links(v: Views) -> DataFrame:
    return validity.sensitive_links(v.articles)


@query
def long_enough(v: Views) -> DataFrame:
    return annotate.long_enough(annotate.add_content_columns(v.articles)).select(
        "id", "content_len"
    )


def _rated(v: Views) -> DataFrame:
    filled = ratings.fill_rating_slots(v.slots, v.ratings, RATING_ORDER)
    return ratings.add_rating_columns(filled)


@query
def min_ratings(v: Views) -> DataFrame:
    return ratings.min_ratings(_rated(v)).select("id", "count_turk_ratings")


@query
def agreed_sensitive(v: Views) -> DataFrame:
    return ratings.agreed_sensitive(_rated(v)).select(
        r6("avg_turk_ratings"), "link"
    )


@query
def blank_template_text(v: Views) -> DataFrame:
    return messages.blank_template_text(v.fetched)


@query
def fill_none(v: Views) -> DataFrame:
    merged = feeds.parse_reply(v.replies).withColumn("reporter_content", F.col("content"))
    return feeds.fill_none(merged)


@query
def crawl_outcome(v: Views) -> DataFrame:
    attached = messages.attach_pages(messages.pending_links(v.links), v.fetched)
    return messages.crawl_outcome(messages.blank_template_text(attached))


@query
def article_label_projection(v: Views) -> DataFrame:
    return ratings.article_label_projection(_rated(v)).select(
        "link", r6("avg_turk_ratings"), "count_turk_ratings"
    )


# --- joins ------------------------------------------------------------------


@query
def stored_status(v: Views) -> DataFrame:
    items = feeds.first_feed_wins(v.feed_items)
    return feeds.stored_status(items, v.stored).select("id", "link", "in_db")


@query
def new_items(v: Views) -> DataFrame:
    return feeds.new_items(feeds.first_feed_wins(v.feed_items), v.stored).select(
        "id", "link", "flag"
    )


@query
def attach_pages(v: Views) -> DataFrame:
    return messages.attach_pages(messages.pending_links(v.links), v.fetched)


@query
def attach_crawled(v: Views) -> DataFrame:
    return messages.attach_crawled(v.messages.select("id", "text"), v.fetched).select(
        "id", "pos", "link_followed", "link_actual", "page_text", "errors"
    )


@query
def merge_api_record(v: Views) -> DataFrame:
    items = feeds.first_feed_wins(v.feed_items).withColumn("title", F.col("link"))
    return feeds.merge_api_record(items, feeds.parse_reply(v.replies)).select(
        "id", "link", "title", "content"
    )


@query
def select_split(v: Views) -> DataFrame:
    keyed = validity.valid_rows(v.articles).select("id", "link", "sensitive_flag")
    return split.select_split(keyed, _split(v))


@query
def only_known_ids(v: Views) -> DataFrame:
    ids = v.table("lineitem").select(F.col("l_partkey").alias("id"))
    return annotate.only_known_ids(v.slots, ids).select("id")


@query
def match_ratings(v: Views) -> DataFrame:
    return ratings.match_ratings(
        v.ratings.select("link_id", "rating", "file", "row_no", "pos"), v.slots
    )


@query
def unmatched_ratings(v: Views) -> DataFrame:
    return ratings.unmatched_ratings(v.ratings.select("link_id", "rating"), v.slots)


def _by_part(v: Views) -> tuple[DataFrame, DataFrame]:
    docs = v.documents
    parts = split.train_test_split(docs, key="doc_id")
    joined = docs.join(parts, "doc_id")
    return joined.filter(F.col("part") == "train"), joined.filter(F.col("part") == "test")


@query
def apply_vocabulary(v: Views) -> DataFrame:
    train, test = _by_part(v)
    vocab = features.fitted_vocabulary(features.count_terms(train))
    return features.apply_vocabulary(features.count_terms(test), vocab)


@query
def bigram_presence(v: Views) -> DataFrame:
    docs = v.labelled_documents
    presence = features.bigram_presence(docs, features.top_bigrams(docs))
    return presence.select("doc_id", F.array_join("present", "|").alias("present"))


@query
def labelled_features(v: Views) -> DataFrame:
    return features.labelled_features(features.word_presence(v.documents), v.labels)


# --- aggregations -----------------------------------------------------------


@query
def pending_count(v: Views) -> DataFrame:
    return messages.pending_count(v.links)


@query
def count_ratings(v: Views) -> DataFrame:
    return _rated(v).select("id", "count_turk_ratings")


@query
def mean_rating(v: Views) -> DataFrame:
    return _rated(v).select("id", r6("avg_turk_ratings"))


@query
def total_ratings(v: Views) -> DataFrame:
    return ratings.total_ratings(
        ratings.fill_rating_slots(v.slots, v.ratings, RATING_ORDER)
    )


def _rounded_description(df: DataFrame) -> DataFrame:
    return df.select(
        "count", *[r6(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


@query
def describe_column(v: Views) -> DataFrame:
    return _rounded_description(ratings.describe_column(_rated(v), "avg_turk_ratings"))


@query
def describe_column_prices(v: Views) -> DataFrame:
    return _rounded_description(ratings.describe_column(v.table("orders"), "o_totalprice"))


@query
def value_counts(v: Views) -> DataFrame:
    return ratings.value_counts(_rated(v), "avg_turk_ratings").select(
        r6("avg_turk_ratings"), "n"
    )


@query
def binned_counts(v: Views) -> DataFrame:
    return ratings.binned_counts(_rated(v))


@query
def candidate_counts(v: Views) -> DataFrame:
    return validity.candidate_counts(v.articles)


@query
def corpus_stats(v: Views) -> DataFrame:
    return corpus.corpus_stats(v.documents).select(
        "documents", "words", r6("mean_words"), "vocabulary"
    )


@query
def term_frequencies(v: Views) -> DataFrame:
    return features.term_frequencies(features.count_terms(v.documents))


@query
def document_frequencies(v: Views) -> DataFrame:
    return features.document_frequencies(features.tfidf_counts(v.documents))


@query
def label_bigram_counts(v: Views) -> DataFrame:
    return features.label_bigram_counts(v.labelled_documents)


@query
def label_bigram_probs(v: Views) -> DataFrame:
    counts = features.label_bigram_counts(v.labelled_documents)
    return features.label_bigram_probs(counts).withColumn("prob", F.round("prob", 9))


@query
def split_consistency(v: Views) -> DataFrame:
    return split.split_consistency(validity.valid_rows(v.articles), _split(v))


@query
def adult_flag(v: Views) -> DataFrame:
    return feeds.adult_flag(v.feed_listing(v.table("pages"))).select(
        "link", "feed_ord", "item_ord", "flag"
    )


@query
def confusion_counts(v: Views) -> DataFrame:
    return metrics.confusion_counts(v.scored)


@query
def precision_recall_f(v: Views) -> DataFrame:
    return metrics.precision_recall_f(v.scored).select(
        "class", r6("precision"), r6("recall"), r6("f_measure")
    )


@query
def f1_score(v: Views) -> DataFrame:
    return metrics.f1_score(v.scored).select(r6("f1"))


@query
def classification_report(v: Views) -> DataFrame:
    return metrics.classification_report(v.scored).select(
        "class", r6("precision"), r6("recall"), r6("f1"), "support"
    )


@query
def last_in_batch(v: Views) -> DataFrame:
    return messages.last_in_batch(messages.commit_batches(v.links))


def _grid_links(v: Views) -> DataFrame:
    sites = [
        v.grid.select(
            F.col(s).alias("site"), (F.col("row_no") * 3 + i).alias("ord")
        )
        for i, s in enumerate(("site1", "site2", "site3"))
    ]
    cells = sites[0].unionByName(sites[1]).unionByName(sites[2])
    return cells.select(
        split_link_key(F.col("site")).try_cast("long").alias("link_id"),
        F.concat(split_link(F.col("site")), F.lit("#"), split_link_key(F.col("site"))).alias("link"),
        F.struct("ord", "site").alias("ord"),
    )


@query
def partial_label_counts(v: Views) -> DataFrame:
    return annotate.partial_label_counts(_grid_links(v))


@query
def partial_batches(v: Views) -> DataFrame:
    return annotate.partial_batches(annotate.partial_label_counts(_grid_links(v)))


@query
def fold_f1(v: Views) -> DataFrame:
    return metrics.fold_f1(v.folds).select("fold", r6("f1"))


@query
def cv_summary(v: Views) -> DataFrame:
    return metrics.cv_summary(metrics.fold_f1(v.folds)).select(
        r6("mean_f1"), r6("spread")
    )


# --- positions --------------------------------------------------------------


@query
def row_index(v: Views) -> DataFrame:
    return split.row_index(v.articles.select("id"))


@query
def commit_batches(v: Views) -> DataFrame:
    return messages.commit_batches(v.links)


@query
def size_chunks(v: Views) -> DataFrame:
    return messages.size_chunks(_sized(v), ["id"], CHUNK_LIMIT)


@query
def progress_marks(v: Views) -> DataFrame:
    return messages.progress_marks(_sized(v), ["id"])


@query
def fill_rating_slots(v: Views) -> DataFrame:
    return ratings.fill_rating_slots(v.slots, v.ratings, RATING_ORDER)


@query
def annotation_batches(v: Views) -> DataFrame:
    return annotate.annotation_batches(_unflagged(v))


@query
def annotation_batches_all(v: Views) -> DataFrame:
    return annotate.annotation_batches(_unflagged(v), drop_last=False)


@query
def train_test_split(v: Views) -> DataFrame:
    return _split(v)


@query
def first_feed_wins(v: Views) -> DataFrame:
    return feeds.first_feed_wins(v.feed_items).select(
        "id", "link", "flag", "feed_ord", "item_ord"
    )


@query
def adjacent_bigrams_of(v: Views) -> DataFrame:
    pairs = features.document_bigrams(v.documents, counted=True)
    return pairs.groupBy("w1", "w2").agg(F.sum("n").alias("n"))


QUERIES["adjacent_bigrams"] = QUERIES.pop("adjacent_bigrams_of")


@query
def shuffle_in_batch(v: Views) -> DataFrame:
    return annotate.shuffle_in_batch(annotate.batch_slots(_unflagged(v))).select(
        "batch", "pos", "id"
    )


# --- sorts and limits -------------------------------------------------------


@query
def bounded_capture(v: Views) -> DataFrame:
    kept = messages.bounded_capture(
        messages.filter_messages(v.messages), CAPTURE_CAP, ["ts", "id"]
    )
    return kept.select("id", "text")


@query
def next_pending(v: Views) -> DataFrame:
    return messages.next_pending(v.links)


@query
def latest_snapshot(v: Views) -> DataFrame:
    return split.latest_snapshot(v.snapshot_names).select(
        "name", stamp_of(F.col("ts")).alias("stamp")
    )


@query
def ranked_terms(v: Views) -> DataFrame:
    return features.ranked_terms(
        features.term_frequencies(features.ngram_terms(v.documents))
    )


@query
def top_bigrams(v: Views) -> DataFrame:
    return features.top_bigrams(v.labelled_documents).withColumn(
        "diff", F.round("diff", 9)
    )


def _bayes_input(v: Views) -> DataFrame:
    docs = v.labelled_documents
    tokens = F.array_distinct(tokens_of(F.col("text")))
    return docs.select("doc_id", "label", F.explode(tokens).alias("feature"))


def _bayes_labels(v: Views) -> DataFrame:
    # Labels of the documents that exist.
    return v.table("documents").select("doc_id").join(v.labels, "doc_id")


@query
def informative_features(v: Views) -> DataFrame:
    weights = models.naive_bayes_weights(_bayes_input(v), _bayes_labels(v))
    return metrics.informative_features(weights).select("feature", "value", r6("ratio"))


# --- set operations ---------------------------------------------------------


@query
def bigram_universe(v: Views) -> DataFrame:
    counts = features.label_bigram_counts(v.labelled_documents)
    return features.bigram_universe(
        counts.filter(F.col("label") == 1), counts.filter(F.col("label") == 0)
    )


@query
def distinct_ids(v: Views) -> DataFrame:
    return annotate.distinct_ids(v.table("lineitem").select(F.col("l_partkey").alias("id")))


@query
def vocabulary(v: Views) -> DataFrame:
    return corpus.vocabulary(v.documents)


@query
def hit_set(v: Views) -> DataFrame:
    return metrics.hit_set(v.scored, 1)


@query
def union_feeds(v: Views) -> DataFrame:
    pages = v.table("pages").select(F.col("url").alias("link"))
    shops = v.table("supplier").select(F.col("s_name").alias("link"))
    goods = v.table("part").select(F.col("p_name").alias("link"))
    return feeds.union_feeds({"pages": pages, "shops": shops, "goods": goods})


@query
def combined_features(v: Views) -> DataFrame:
    docs = v.labelled_documents
    presence = features.bigram_presence(docs, features.top_bigrams(docs))
    return features.combined_features(
        features.word_presence(docs), features.presence_features(presence)
    )


# --- scalar functions -------------------------------------------------------


@query
def extract_links(v: Views) -> DataFrame:
    on_messages = v.messages.select("id", F.array_join(links_of(F.col("text")), " ").alias("links"))
    on_pages = v.table("pages").select(
        (-F.col("page_id") - 1).alias("id"), F.array_join(links_of(F.col("url")), " ").alias("links")
    )
    return on_messages.unionByName(on_pages)


@query
def explode_links(v: Views) -> DataFrame:
    return messages.explode_links(v.messages).select("id", "pos", "link")


@query
def unpivot_ratings(v: Views) -> DataFrame:
    pairs = ratings.unpivot_ratings(
        v.grid, ("site1", "site2", "site3"), ("answer1", "answer2", "answer3")
    )
    return ratings.parse_ratings(pairs)


@query
def html_to_text(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text_of_html(F.col("html")).alias("content"))


@query
def simple_tokens(v: Views) -> DataFrame:
    return v.documents.select(
        "doc_id", F.array_join(tokens_of(F.col("text")), "|").alias("tokens")
    )


@query
def word_tokens(v: Views) -> DataFrame:
    return v.documents.select(
        "doc_id", F.array_join(words_of(F.col("text")), "\n").alias("tokens")
    )


@query
def bigram_length_filter(v: Views) -> DataFrame:
    return (
        features.document_bigrams(v.documents)
        .filter(longer_word(F.col("w1"), F.col("w2")))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def stamp_name(v: Views) -> DataFrame:
    return v.table("events").select(
        "event_id",
        stamp_of(F.col("ts")).alias("split_stamp"),
        stamp_of(F.col("ts"), FEED_STAMP).alias("feed_stamp"),
    )


@query
def parse_snapshot_time(v: Views) -> DataFrame:
    return v.snapshot_names.select(
        "name",
        F.date_format(time_in_name(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("time"),
    )


@query
def word_count(v: Views) -> DataFrame:
    return v.documents.select("doc_id", words_in(F.col("text")).alias("words"))


@query
def link_key(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", key_of_link(F.col("url")).alias("key"))


@query
def rating_bin(v: Views) -> DataFrame:
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount",
        bin_of(F.col("l_discount") * 10).alias("bin"),
    )


@query
def sensitive_label(v: Views) -> DataFrame:
    return _rated(v).select("id", label_of(F.col("avg_turk_ratings")).alias("label"))


@query
def compose_link_id(v: Views) -> DataFrame:
    return v.articles.select("id", composed(F.col("link"), F.col("id")).alias("site"))


@query
def split_link_id(v: Views) -> DataFrame:
    url = F.col("url")
    return v.table("pages").select(
        "page_id", split_link(url).alias("link"), split_link_key(url).alias("link_id")
    )


@query
def clip80(v: Views) -> DataFrame:
    return v.documents.select("doc_id", clip80_of(F.col("text")).alias("clipped"))


@query
def count_terms(v: Views) -> DataFrame:
    return features.count_terms(v.documents)


@query
def ngram_terms(v: Views) -> DataFrame:
    return features.ngram_terms(v.documents)


@query
def tfidf_terms(v: Views) -> DataFrame:
    return features.tfidf_terms(v.documents).select("doc_id", "term", r6("weight"))


@query
def word_presence(v: Views) -> DataFrame:
    return features.word_presence(v.documents)


@query
def parse_reply(v: Views) -> DataFrame:
    return feeds.parse_reply(v.replies)


# --- learning ---------------------------------------------------------------


@query
def naive_bayes_table(v: Views) -> DataFrame:
    table = models.naive_bayes_table(_bayes_input(v), _bayes_labels(v))
    return table.withColumn("prob", F.round("prob", 9))


@query
def naive_bayes_predict(v: Views) -> DataFrame:
    """Fitted on the labelled documents, applied to all."""
    weights = models.naive_bayes_weights(_bayes_input(v), _bayes_labels(v))
    predicted = models.naive_bayes_predict(
        weights, _bayes_labels(v), v.documents, features.word_presence(v.documents)
    )
    return predicted.select("doc_id", r6("score0"), r6("score1"), "prediction")


@query
def naive_bayes_predict_bigrams(v: Views) -> DataFrame:
    """Fixed bigram features, where an absent feature counts as false."""
    docs = v.labelled_documents
    present = features.presence_features(
        features.bigram_presence(docs, features.top_bigrams(docs))
    )
    weights = models.naive_bayes_weights(
        features.labelled_features(present, v.labels), _bayes_labels(v)
    )
    predicted = models.naive_bayes_predict(
        weights, _bayes_labels(v), docs, present, absent_counts=True
    )
    return predicted.select("doc_id", r6("score0"), r6("score1"), "prediction")


def _bayes_scores(v: Views) -> DataFrame:
    weights = models.naive_bayes_weights(_bayes_input(v), _bayes_labels(v))
    return models.naive_bayes_predict(
        weights, _bayes_labels(v), v.documents, features.word_presence(v.documents)
    )


@query
def predict_proba_bayes(v: Views) -> DataFrame:
    return models.bayes_probabilities(_bayes_scores(v)).select("doc_id", r6("p0"), r6("p1"))


@query
def write_probabilities_bayes(v: Views) -> DataFrame:
    """Written as CSV and read back."""
    path = scratch_path(v.spark, "proba-bayes")
    sources.write_probabilities(models.bayes_probabilities(_bayes_scores(v)), path)
    back = v.spark.read.option("header", True).schema("doc_id long, p0 double, p1 double").option(
        "enforceSchema", True
    ).csv(path)
    return back.select("doc_id", r6("p0"), r6("p1"))


def _bayes_coefficients(v: Views) -> DataFrame:
    return models.bayes_coefficients(
        models.naive_bayes_weights(_bayes_input(v), _bayes_labels(v))
    )


@query
def coefficient_density_bayes(v: Views) -> DataFrame:
    found = metrics.coefficient_density(_bayes_coefficients(v))
    return found.withColumn("density", F.round("density", 9))


@query
def top_coefficients_bayes(v: Views) -> DataFrame:
    return metrics.top_coefficients(_bayes_coefficients(v)).withColumn(
        "coef", F.round("coef", 9)
    )


def _model_parts(
    v: Views, model_type: str, fit_features=models.fit_features
) -> tuple[models.Featurizer | models.MarkedFeaturizer, DataFrame, DataFrame]:
    docs = v.labelled_documents
    parts = split.train_test_split(docs, key="doc_id")
    joined = docs.join(parts, "doc_id").withColumn("label", F.col("label").cast("double"))
    train = joined.filter(F.col("part") == "train")
    fitted = fit_features(train, model_type)
    return fitted, fitted.transform(train, known=True), fitted.transform(
        joined.filter(F.col("part") == "test")
    )


_LINEAR_FITS: dict[tuple[str, str, str], logistic.LogisticFit] = {}


def _linear_parts(v: Views, model_type: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents and terms, of the train part and of the test part."""
    docs = v.labelled_documents.filter("label IS NOT NULL")
    parts = split.train_test_split(docs, key="doc_id")
    joined = docs.join(parts, "doc_id")
    train, test = (joined.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    own, others = (logistic.linear_terms(d, train, model_type) for d in (train, test))
    return train, own, test, others


def _linear_fit(v: Views, model_type: str, train: DataFrame, terms: DataFrame) -> logistic.LogisticFit:
    """The model of a type on the train part, fitted once per application."""
    key = (v.spark.sparkContext.applicationId, v.folder, model_type)
    if key not in _LINEAR_FITS:
        _LINEAR_FITS[key] = logistic.fit_logistic_terms(terms, train.select("doc_id", "label"))
    return _LINEAR_FITS[key]


def _linear_margins(v: Views, model_type: str) -> tuple[DataFrame, DataFrame]:
    """Margins and labels of the test part."""
    train, terms, test, test_terms = _linear_parts(v, model_type)
    fit = _linear_fit(v, model_type, train, terms)
    return logistic.margins(fit, test, test_terms), test.select("doc_id", "label")


@query
def fit_logistic(v: Views) -> DataFrame:
    """Coefficients of the logistic model on unigram counts."""
    train, terms, _, _ = _linear_parts(v, "Basic")
    return _linear_fit(v, "Basic", train, terms).weights.select("feature", "coef")


@query
def fit_logistic_optimality(v: Views) -> DataFrame:
    """Every feature of the model with its documents and count, and whether its
    optimality condition, computed anew from the documents, is met."""
    train, terms, _, _ = _linear_parts(v, "Basic")
    fit = _linear_fit(v, "Basic", train, terms)
    found = logistic.residuals(fit, terms, train.select("doc_id", "label"))
    return found.select(
        "feature", "docs", F.col("total").cast("long").alias("total"), (F.col("residual") <= 1.001e-3).alias("optimal")
    )


@query
def fit_logistic_tfidf(v: Views) -> DataFrame:
    return metrics.confusion_counts(logistic.predictions(*_linear_margins(v, "InvDocFreq")))


@query
def fit_logistic_ngrams(v: Views) -> DataFrame:
    return metrics.confusion_counts(logistic.predictions(*_linear_margins(v, "BasicBigram")))


@query
def fit_rbf_svm(v: Views) -> DataFrame:
    fitted, train, test = _model_parts(v, "Basic", models.fit_kernel_features)
    model = models.fit_rbf_svm(train, fitted.size)
    return metrics.confusion_counts(models.predict(model, test))


def _tree_documents(docs: DataFrame, selected: DataFrame) -> DataFrame:
    presence = features.bigram_presence(docs, selected).withColumnRenamed("present", "features")
    return presence.join(docs.select("doc_id", "label"), "doc_id")


def _tree_scored(v: Views, criterion: str) -> DataFrame:
    """Predictions for the test part of a tree on the selected bigrams."""
    docs = v.labelled_documents.filter("label IS NOT NULL")
    joined = docs.join(split.train_test_split(docs, key="doc_id"), "doc_id")
    train, test = (joined.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    # Read twice, made once.
    path = scratch_path(v.spark, "tree-bigrams")
    features.top_bigrams(train).write.parquet(path)
    selected = v.spark.read.parquet(path)
    tree = trees.fit_tree(_tree_documents(train, selected), criterion)
    held = _tree_documents(test, selected)
    return trees.tree_predict(tree, held).join(held.select("doc_id", "label"), "doc_id")


@query
def fit_decision_tree(v: Views) -> DataFrame:
    return metrics.confusion_counts(_tree_scored(v, "entropy"))


@query
def fit_decision_tree_error(v: Views) -> DataFrame:
    """Splits by the number of errors, as the original's classifier does."""
    return metrics.confusion_counts(_tree_scored(v, "error"))


@query
def decision_tree_nodes(v: Views) -> DataFrame:
    """The upper two levels of the tree on words, and what its leaves hold."""
    words = F.array_distinct(tokens_of(F.col("text")))
    docs = v.labelled_documents.select("doc_id", "label", F.filter(words, lambda w: w != "").alias("features"))
    tree = trees.fit_tree(docs)
    leaves = tree.filter(F.col("feature").isNull()).agg(
        F.struct(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).alias("s")
    )
    return tree.filter(F.col("depth") <= 1).select(
        "node",
        "n0",
        "n1",
        F.when(F.col("depth") == 0, F.col("feature")).alias("split"),
        leaves.scalar().getField("n0").alias("leaves_n0"),
        leaves.scalar().getField("n1").alias("leaves_n1"),
    )


@query
def predict(v: Views) -> DataFrame:
    return logistic.predictions(*_linear_margins(v, "Basic"))


@query
def predict_proba(v: Views) -> DataFrame:
    return logistic.probabilities(_linear_margins(v, "Basic")[0])


@query
def write_probabilities(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "proba")
    sources.write_probabilities(logistic.probabilities(_linear_margins(v, "BasicBigram")[0]), path)
    return v.spark.read.option("header", True).schema(
        "doc_id long, `0` double, `1` double"
    ).csv(path)


@query
def coefficient_density(v: Views) -> DataFrame:
    return metrics.coefficient_density(QUERIES["fit_logistic"](v.spark, v.folder))


@query
def top_coefficients(v: Views) -> DataFrame:
    return metrics.top_coefficients(QUERIES["fit_logistic"](v.spark, v.folder))


@query
def cross_validate_f1(v: Views) -> DataFrame:
    _, train, _ = _model_parts(v, "Basic")
    return models.cross_validate_f1(train)


@query
def cross_validate_f1_bayes(v: Views) -> DataFrame:
    """Ten naive Bayes models from one aggregate, each judged on its own fold."""
    labels = _bayes_labels(v).join(v.documents.select("doc_id"), "doc_id", "left_semi").filter("label IS NOT NULL")
    folds = models.stratified_folds(labels, hashed=F.md5(F.col("doc_id").cast("string")))
    found = models.cross_validate_bayes(features.word_presence(v.documents), labels.join(folds, "doc_id"))
    return found.select("fold", r6("f1"))


# --- streams ----------------------------------------------------------------


def _drain(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def _message_stream(v: Views) -> DataFrame:
    return v.stream("events").selectExpr(*MESSAGE_COLS)


@query
def stream_capture(v: Views) -> DataFrame:
    out, mark = scratch_path(v.spark, "capture"), scratch_path(v.spark, "mark")
    _drain(streaming.stream_capture(_message_stream(v), out, mark))
    return v.spark.read.parquet(out)


@query
def stream_bounded(v: Views) -> DataFrame:
    out, mark = scratch_path(v.spark, "bounded"), scratch_path(v.spark, "mark")
    _drain(
        streaming.stream_bounded(_message_stream(v), out, mark, CAPTURE_CAP, ["ts", "id"])
    )
    return v.spark.read.parquet(out).drop("batch")


@query
def stream_links(v: Views) -> DataFrame:
    out, mark = scratch_path(v.spark, "crawled"), scratch_path(v.spark, "mark")
    source = _message_stream(v).select("id", "text")
    _drain(streaming.stream_links(source, v.fetched, out, mark))
    return v.spark.read.parquet(out).drop("batch", "text")


@query
def stream_new_articles(v: Views) -> DataFrame:
    out, mark = scratch_path(v.spark, "fresh"), scratch_path(v.spark, "mark")
    items = feeds.key_items(feeds.adult_flag(v.feed_listing(v.stream("pages")))).drop("rating")
    _drain(streaming.stream_new_articles(items, v.stored, out, mark))
    return v.spark.read.parquet(out).select("id", "link", "flag")


@query
def stream_ratings(v: Views) -> DataFrame:
    table, mark = scratch_path(v.spark, "slots"), scratch_path(v.spark, "mark")
    sources.write_table_version(v.slots, table, 0)
    source = v.stream("lineitem").selectExpr(*RATING_COLS)
    _drain(streaming.stream_ratings(source, table, mark, RATING_ORDER))
    versions = v.spark.read.parquet(table)
    newest = versions.agg(F.max("version").alias("version")).scalar()
    return versions.filter(F.col("version") == newest).drop("version")


@query
def stream_message_table(v: Views) -> DataFrame:
    """Appended, crawled and read back as one table."""
    table = scratch_path(v.spark, "message-table")
    marks = scratch_path(v.spark, "mark"), scratch_path(v.spark, "mark")
    source = _message_stream(v).select("id", "text")
    _drain(streaming.stream_appends(source, table, marks[0]))
    _drain(streaming.stream_crawl(v.spark, v.fetched, table, marks[1]))
    return streaming.read_message_table(v.spark, table).drop("row_id", "text")


@query
def stream_rating_changes(v: Views) -> DataFrame:
    changes, mark = scratch_path(v.spark, "changes"), scratch_path(v.spark, "mark")
    source = v.stream("lineitem").selectExpr(*RATING_COLS)
    _drain(streaming.stream_rating_changes(source, v.slots, changes, mark, RATING_ORDER))
    return streaming.rated_articles(v.slots, v.spark.read.parquet(changes))

"""One registered query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primrose.llm import (
    ann,
    exact,
    langid,
    mixing,
    neardup,
    negatives,
    packing,
    quality,
    substring,
    tokencount,
    urlfilter,
    warc,
    whitening,
)
from primrose.llm.common import held_out, table

HOST_RULES = (
    urlfilter.HostRule("block", "net", "/"),
    urlfilter.HostRule("allow", "example.net", "/en/"),
    urlfilter.HostRule("block", "example.com", "/de/"),
    urlfilter.HostRule("allow", "org", "/fr/"),
)
MIX_WEIGHTS, MIX_CAP = (1.0, 2.0, 3.0), 3.0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, weights=MIX_WEIGHTS, cap=MIX_CAP).drop("copies")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_texts(docs.filter(~held_out("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.duplicate_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.rule_table(spark, HOST_RULES)
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(*quality.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def whitening_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix_sources,
    "op2_language_id": language_id,
    "op3_substring_dedup": substring_dedup,
    "op4_nearest_vectors": nearest_vectors,
    "op5_url_filter": url_filter,
    "op6_quality_score": quality_score,
    "op7_pack_sequences": pack_sequences,
    "op8_exact_dedup": exact_dedup,
    "op9_near_dedup": near_dedup,
    "op10_warc_round_trip": warc_round_trip,
    "op11_token_counts": token_counts,
    "op12_hard_negatives": hard_negatives,
    "op13_whitening": whitening_components,
}

"""Document features in long form, and the bigram selection.

A document lies in one row, so tokens, per-document counts and distinct tokens
are computed in the row. What is exchanged are terms with counts, combined on
the map side first, never token occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from primrose.functions.text import (
    PUNCTUATION,
    adjacent_bigrams,
    bigram_length_filter,
    content_terms,
    ngram_words,
    raw_tokens,
    simple_tokens,
    tfidf_tokens,
    word_tokens,
)
from primrose.session import scratch_path, ship_package

# Fixed values of the bigram selection.
MIN_FREQ = 3
MIN_WORD_LEN = 3
TOP_BIGRAMS = 1000

# The largest selection a fitted model keeps as one constant.
NAMED_SELECTION = 10_000


# Words of documents that are counted together.
COUNTED_WORDS = 1 << 20


def _runs_counted(words: pa.ListArray, low: int, high: int):
    """``(row, term, n)`` of the runs of ``low`` .. ``high`` words in each row.
    Words and runs are numbered, so only what is kept is spelled out."""
    coded = words.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    sizes = words.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    run, spelled = code, names
    for n in range(1, high + 1):
        if n > 1:
            held = np.flatnonzero(row[: 1 - n] == row[n - 1 :])
            pairs, found = np.unique(run[held] * len(names) + code[held + n - 1], return_inverse=True)
            first, last = np.divmod(pairs, max(len(names), 1))
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(first)), names.take(pa.array(last)), " ")
            run = np.full(len(code), -1, np.int64)
            run[held] = found
        if n >= low:
            mine = np.flatnonzero(run >= 0)
            keys, counts = np.unique(row[mine] * max(len(spelled), 1) + run[mine], return_counts=True)
            place, term = np.divmod(keys, max(len(spelled), 1))
            yield place, spelled.take(pa.array(term)), counts


def _counter(low: int, high: int) -> Callable:
    def count(batches):
        for b in batches:
            sizes = b.column("words").value_lengths().fill_null(0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // COUNTED_WORDS, prepend=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                part = b.slice(lo, hi - lo)
                for row, terms, counts in _runs_counted(part.column("words"), low, high):
                    ids = part.column("doc_id").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, terms, pa.array(counts, pa.int64())], ["doc_id", "term", "n"])

    return count


def _counted(docs: DataFrame, words: Column, low: int = 1, high: int = 1) -> DataFrame:
    """``(doc_id, term, n)``: how often each row holds each run of ``words``."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", words.alias("words"))
    return held.mapInArrow(_counter(low, high), f"doc_id {kind}, term string, n long")


def count_terms(docs: DataFrame) -> DataFrame:
    """Unigram counts ``(doc_id, term, n)`` without stop words."""
    return _counted(docs, content_terms(F.col("text")))


def ngram_terms(docs: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """Counts of n-grams over the stop-word-free sequence."""
    return _counted(docs, ngram_words(F.col("text")), low, high)


def tfidf_counts(docs: DataFrame) -> DataFrame:
    """Term counts with stop words, the input of :func:`tfidf_terms`."""
    return _counted(docs, tfidf_tokens(F.col("text")))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """Documents per term; ``terms`` is unique per document and term."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("n").alias("n"))


def ranked_terms(freqs: DataFrame) -> DataFrame:
    """Terms by falling frequency, ties in alphabetical order."""
    return freqs.orderBy(F.desc("n"), "term")


TERM_SALTS = 16
# A term is common when it has more than this share of all rows; there are at
# most that many common terms, whatever the input.
COMMON_SHARE = 1024
COMMON_ROWS = 1000


def join_by_term(
    rows: DataFrame, model: DataFrame, term: str = "term", count: str | None = None
) -> DataFrame:
    """``rows`` (with ``doc_id``) joined with ``model``, one row per term.

    A term may stand in every document. The model side is an aggregate, which
    leaves Spark no exchange to split, so the rows of a term are dealt over
    several tasks by document, and the model is repeated for each.

    ``count`` names the column of ``model`` that says how many rows a term has,
    at least roughly. Then only common terms are dealt, over as many tasks as
    their share of all rows needs: at most ``COMMON_SHARE`` names are broadcast
    and about twice as many model rows repeated. Counts that are null or wrong
    cost time, never rows. Without ``count`` every term is dealt over
    ``TERM_SALTS`` tasks.
    """
    if count is None:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(TERM_SALTS)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1)))
        return (
            rows.withColumn("__salt", salt)
            .join(model.withColumn("__salt", each), [term, "__salt"])
            .drop("__salt")
        )
    # The join asks for this anyway; said here, all reads of the model are the
    # same plan and its exchange is made once.
    model = model.filter(F.col(term).isNotNull())
    share = model.agg(F.sum(count).alias("__all")).scalar() / COMMON_SHARE
    limit = F.greatest(share, F.lit(float(COMMON_ROWS)))
    tasks = F.when(F.col(count) > limit, F.ceil(F.col(count) / limit)).otherwise(1).cast("int")
    sized = model.withColumn("__tasks", tasks)
    common = sized.filter("__tasks > 1").select(term, "__tasks")
    dealt = F.pmod(F.xxhash64("doc_id"), F.coalesce("__tasks", F.lit(1))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1))
    return (
        rows.join(F.broadcast(common), term, "left")
        .withColumn("__salt", dealt)
        .drop("__tasks")
        .join(sized.withColumn("__salt", each).drop("__tasks"), [term, "__salt"])
        .drop("__salt")
    )


def tfidf_terms(docs: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """``(doc_id, term, weight)``: tf * (ln((1+n)/(1+df)) + 1), unit length per
    document. ``fitted_on`` supplies the document frequencies (default: the
    documents themselves); terms unknown there are left out.

    Two exchanges carry term rows: one by term (a very common term is dealt
    over several tasks), one by document for the norm.
    """
    base = docs if fitted_on is None else fitted_on
    df = document_frequencies(tfidf_counts(base))
    n = base.agg(F.count(F.lit(1)).alias("docs")).scalar()
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    raw = (
        join_by_term(tfidf_counts(docs), df, count="df")
        .select("doc_id", "term", (F.col("n") * idf).alias("w"))
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def apply_vocabulary(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms restricted to a fitted vocabulary (distinct ``term``)."""
    return join_by_term(terms, vocab.select("term")).select(*terms.columns)


def fitted_vocabulary(terms: DataFrame) -> DataFrame:
    return terms.select("term").distinct()


def word_presence(docs: DataFrame) -> DataFrame:
    """``(doc_id, feature)`` per distinct token: the features that are true."""
    tokens = F.array_distinct(simple_tokens(F.col("text")))
    return docs.select("doc_id", F.explode(tokens).alias("feature"))


def word_presence_map(docs: DataFrame) -> DataFrame:
    """The same as one ``MAP<STRING, BOOLEAN>`` per document."""
    tokens = F.array_distinct(simple_tokens(F.col("text")))
    return docs.select(
        "*",
        F.map_from_arrays(tokens, F.transform(tokens, lambda _: F.lit(True))).alias(
            "features"
        ),
    )


# Words whose neighbouring pairs are counted together, and rows handed on at once.
PAIRED_WORDS = 1 << 22
PAIR_ROWS = 1 << 17

# The tokens that ``word_tokens`` leaves out.
_PUNCTUATION_RUNS = sorted(
    {PUNCTUATION[i:j] for i in range(len(PUNCTUATION)) for j in range(i, len(PUNCTUATION) + 1)}
)


def _pairs_counted(words: pa.Array, label: pa.Array | None = None):
    """``(w1, w2, n)`` of the neighbouring words in the rows of ``words``, raw
    tokens; with ``label``, ``(label, w1, w2, n)``. Words are numbered, so only
    the pairs found are spelled out.

    Punctuation goes before pairs are made. A-Z are lower-cased here, so that
    most spellings of a word share a number; the caller lower-cases the rest.
    """
    coded = words.flatten().dictionary_encode()
    lower = pc.ascii_lower(coded.dictionary).dictionary_encode()
    names, code = lower.dictionary, lower.indices.to_numpy()[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
    dropped = pc.is_in(names, pa.array(_PUNCTUATION_RUNS)).to_numpy(zero_copy_only=False)
    held = np.flatnonzero(~dropped[code])
    code, row = code[held].astype(np.int64), row[held]
    left = np.flatnonzero(row[1:] == row[:-1])
    first, second, size = code[left], code[left + 1], max(len(names), 1)
    if label is not None:
        marks = label.take(pa.array(row[left])).dictionary_encode("encode")
        # Numbered again, so that the products below stay small.
        firsts = pa.array(marks.indices.to_numpy() * np.int64(size) + first).dictionary_encode()
        first = firsts.indices.to_numpy().astype(np.int64)
    keys, counts = np.unique(first * size + second, return_counts=True)
    first, second = np.divmod(keys, size)
    if label is not None:
        mark, first = np.divmod(firsts.dictionary.to_numpy()[first], size)
    for at in range(0, len(keys), PAIR_ROWS):
        part = slice(at, at + PAIR_ROWS)
        pairs = [names.take(pa.array(first[part])), names.take(pa.array(second[part])), pa.array(counts[part], pa.int64())]
        yield pairs if label is None else [marks.dictionary.take(pa.array(mark[part])), *pairs]


def _pair_counter(batches):
    """Counts the pairs of about ``PAIRED_WORDS`` words at a time, whatever the
    size of a batch or of a partition."""

    def counted(parts):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()
        for r in rows:
            label = r.column("label") if "label" in r.schema.names else None
            for columns in _pairs_counted(r.column("words"), label):
                names = [*(["label"] if label is not None else []), "w1", "w2", "n"]
                yield pa.RecordBatch.from_arrays(columns, names)

    held, size = [], 0
    for b in batches:
        # A row counts as one more word, so rows without words are bounded, too.
        ends = np.cumsum(b.column("words").value_lengths().fill_null(0).to_numpy() + np.int64(1))
        at = 0
        while at < len(b):
            done = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, done + PAIRED_WORDS - size, "right"))
            if to <= at and held:
                yield from counted(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1] - done)
            at = to
    if held:
        yield from counted(held)


def _pair_counts(docs: DataFrame, words: Column, *keys: str) -> DataFrame:
    """``(*keys, w1, w2, n)``; ``keys`` is nothing or ``label``. A pair has a row
    for each run of documents counted together. Callers exchange these rows by
    pair before adding them up: a table of pairs made before the exchange grows
    with the partitions of the input and is sorted and spilled when these are large."""
    ship_package(docs.sparkSession)
    kinds = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys]
    held = docs.select(*keys, words.alias("words"))
    pairs = held.mapInArrow(_pair_counter, ", ".join([*kinds, "w1 string, w2 string, n long"]))
    return pairs.select(*keys, F.lower("w1").alias("w1"), F.lower("w2").alias("w2"), "n")


def document_bigrams(docs: DataFrame, counted: bool = False) -> DataFrame:
    """Every neighbouring pair of every document: ``(doc_id, w1, w2)``.

    With ``counted``, ``(w1, w2, n)``: pairs counted for many documents
    together. A pair may have several rows, in one partition, which are still to
    be added up.
    """
    if counted:
        return _pair_counts(docs, raw_tokens(F.col("text"))).repartition("w1", "w2")
    return docs.select("doc_id", F.inline(adjacent_bigrams(word_tokens(F.col("text")))))


def _counted_bigrams(text: Column) -> Column:
    """The tokens of a text whose bigrams are counted."""
    return raw_tokens(text)


def _label_pairs(docs: DataFrame) -> DataFrame:
    """``(label, w1, w2, n)``, still to be added up: pairs with a long word."""
    pairs = _pair_counts(docs, _counted_bigrams(F.col("text")), "label")
    return pairs.filter(bigram_length_filter(F.col("w1"), F.col("w2"), MIN_WORD_LEN)).repartition("w1", "w2")


def label_bigram_counts(docs: DataFrame) -> DataFrame:
    """``(label, w1, w2, n)``; ``docs`` has ``text`` and ``label`` 0 or 1."""
    return _label_pairs(docs).groupBy("label", "w1", "w2").agg(F.sum("n").alias("n"))


def label_bigram_probs(counts: DataFrame) -> DataFrame:
    """Share of each bigram within its label.

    Labels are 0 and 1 (others are left out), so the totals have two rows; a
    window per label would put half of the bigrams into one task.
    """
    binary = counts.filter(F.col("label").isin(0, 1))
    totals = binary.groupBy("label").agg(F.sum("n").alias("total"))
    return (
        binary.join(F.broadcast(totals), "label")
        .withColumn("prob", F.col("n") / F.col("total").cast("double"))
        .drop("total")
    )


def bigram_universe(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bigrams of either side, once."""
    return a.select("w1", "w2").union(b.select("w1", "w2")).distinct()


def bigram_label_table(docs: DataFrame) -> DataFrame:
    """``(w1, w2, n_pos, n_neg)``: one row per bigram of either label."""
    pairs = _label_pairs(docs.filter(F.col("label").isin(0, 1)))
    return pairs.groupBy("w1", "w2").agg(
        *[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "n_pos"), (0, "n_neg"))]
    )


def top_bigrams(
    docs: DataFrame, n: int = TOP_BIGRAMS, min_freq: int = MIN_FREQ
) -> DataFrame:
    """The ``n`` bigrams whose probabilities differ most between the labels.

    Kept when seen ``min_freq`` times under either label; ties are broken by
    the bigram, descending. The aggregated table is written, because the label
    totals read it again and would make it again; the cut is a top-k per task.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "label-bigrams")
    bigram_label_table(docs).write.parquet(path)
    table = spark.read.parquet(path)
    totals = table.agg(
        F.struct(
            F.sum("n_pos").cast("double").alias("pos"),
            F.sum("n_neg").cast("double").alias("neg"),
        ).alias("totals")
    ).scalar()
    p = F.coalesce(F.try_divide("n_pos", totals.getField("pos")), F.lit(0.0))
    q = F.coalesce(F.try_divide("n_neg", totals.getField("neg")), F.lit(0.0))
    return (
        table.filter((F.col("n_pos") >= min_freq) | (F.col("n_neg") >= min_freq))
        .select("w1", "w2", "n_pos", "n_neg", F.abs(p - q).alias("diff"))
        .orderBy(F.desc("diff"), F.desc("w1"), F.desc("w2"))
        .limit(n)
    )


def _bigram_names(text: Column) -> Column:
    return F.transform(
        adjacent_bigrams(word_tokens(text)),
        lambda b: F.concat_ws(" ", b.getField("w1"), b.getField("w2")),
    )


def selected_names(selected: DataFrame, limit: int = NAMED_SELECTION) -> list[str] | None:
    """The selected bigrams as text, or ``None`` when they are more than
    ``limit``; at most ``limit + 1`` rows reach the driver."""
    rows = selected.select("w1", "w2").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return sorted(f"{r.w1} {r.w2}" for r in rows)


def present_bigrams(text: Column, names: list[str]) -> Column:
    """The selected bigrams a text holds. Tokens hold no white space, so the
    joined names are unambiguous and the list is one constant."""
    if not names:
        return F.array().cast("array<string>")
    chosen = F.split(F.lit("\n".join(names)), "\n")
    return F.array_intersect(_bigram_names(text), chosen)


def bigram_presence(docs: DataFrame, selected: DataFrame) -> DataFrame:
    """``present``: the selected bigrams each document holds, sorted; every
    other selected bigram is false for it.

    One lazy plan, whatever the size of the selection: the distinct bigrams of
    a document are joined with it (a very common one is dealt over several
    tasks) and what matches is regrouped. ``doc_id`` is unique.
    """
    pairs = docs.select(
        "doc_id", F.explode(F.array_distinct(_bigram_names(F.col("text")))).alias("bigram")
    )
    wanted = selected.select(F.concat_ws(" ", "w1", "w2").alias("bigram")).distinct()
    held = (
        join_by_term(pairs, wanted, "bigram")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("bigram")).alias("present"))
    )
    empty = F.array().cast("array<string>")
    return docs.select("doc_id").join(held, "doc_id", "left").select(
        "doc_id", F.coalesce("present", empty).alias("present")
    )


def presence_features(presence: DataFrame) -> DataFrame:
    """Long form ``(doc_id, feature)`` of :func:`bigram_presence`."""
    return presence.select("doc_id", F.explode("present").alias("feature"))


def presence_map(presence: DataFrame, names: list[str]) -> DataFrame:
    """Row form: every selected bigram to true or false."""
    chosen = F.split(F.lit("\n".join(names)), "\n")
    flags = F.transform(chosen, lambda b: F.array_contains("present", b))
    return presence.select("doc_id", F.map_from_arrays(chosen, flags).alias("features"))


def combined_features(uni: DataFrame, bi: DataFrame) -> DataFrame:
    """Word and bigram features of each document. A bigram name holds a space
    and a word never does, so the two cannot clash."""
    return uni.select("doc_id", "feature").unionByName(bi.select("doc_id", "feature"))


def labelled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select("doc_id", "label"), "doc_id", "inner")

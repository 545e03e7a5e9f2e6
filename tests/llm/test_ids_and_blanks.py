"""Ids that a float cannot hold, beside null ids, long runs of blanks, and the
spread of archives over tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from primrose.llm import exact, langid, neardup, packing, quality, warc
from primrose.llm.queries import tokenizer_path

BIG = 2**53


@pytest.fixture
def odd_ids(spark):
    rows = [(BIG + 1, "the red house"), (None, "une maison"), (BIG + 3, None), (BIG + 1, "the red house")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def ids_of(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=lambda i: (i is None, i))


WANTED = [BIG + 1, BIG + 1, BIG + 3, None]


def test_language_id_hands_ids_on(odd_ids):
    model = langid.fit({"en": "the house is red and the door is old", "fr": "la maison est rouge et la porte"})
    found = langid.identify(odd_ids, model)
    assert ids_of(found) == WANTED
    assert {r["lang_pred"] for r in found.filter(F.col("doc_id") == BIG + 3).collect()} == {"und"}


def test_quality_hands_ids_on(odd_ids):
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(["good", "bad"]) for _ in range(30))).encode() for _ in range(20)]
    model = quality.fit(texts, [i % 2 for i in range(20)])
    assert ids_of(quality.score_quality(odd_ids, model)) == WANTED


def test_long_runs_of_blanks_are_packed(spark):
    texts = ["a" + " " * 1_500_000 + "b", " \n" * 3000, "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = packing.pack_documents(docs, tokenizer_path())
    got = {r["doc_id"]: r["n"] for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert got == want


def test_a_text_the_fast_library_gives_up_on(monkeypatch):
    ids = packing.TokenIds(tokenizer_path())
    monkeypatch.setattr(packing, "_LONG_BLANK", packing.re.compile("(?!)"))
    text = "x" + " " * 1_500_000 + "y"
    assert len(np.frombuffer(ids.of([text])[0], "<u4")) == len(ids.tokenizer.encode(text, add_special_tokens=False).ids)


def test_archives_are_read_by_as_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://x.org/{i}", "".join(chr(rng.randrange(33, 900)) for _ in range(300))) for i in range(4000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    records = warc.plan_records(pages, "page_id", "url", "html")
    manifest = warc.write_archives(records, str(tmp_path), archive_bytes=1000)
    archives = manifest.count()
    read = warc.read_archives(manifest, with_payload=False)
    tasks = read.select(F.spark_partition_id().alias("t"), "record_id")
    assert archives >= 10 and tasks.select("record_id").distinct().count() == 4000
    # Rows are dealt in turn from each part of the manifest.
    assert tasks.select("t").distinct().count() >= archives / 2


def test_exact_groups_of_texts_with_equal_heads(spark):
    """Splitters are short; texts that differ late are still told apart."""
    head = "same beginning " * 20
    rows = [(i, head + str(i % 5)) for i in range(40)] + [(100, head.upper() + "0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs, keep="largest").collect()}
    assert got[100] == (100, 9) and got[0] == (100, 9) and got[39] == (39, 8) and got[1] == (36, 8)


def test_near_duplicates_without_ids(spark, monkeypatch):
    """Rows without an id are confirmed once each, not all with all, and
    repeated rows leave one text for each node."""
    seen = spark.sparkContext.accumulator(0)
    confirm = neardup._confirm

    def counted(percent):
        inner = confirm(percent)

        def run(batches):
            def count():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from inner(count())

        return run

    monkeypatch.setattr(neardup, "_confirm", counted)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        w[3 * i] = f"x{i}"
        rows += [(None, " ".join(w))] * (3 if i < 10 else 1)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 80 and {r.component_id for r in got} == {None}
    assert 0 < seen.value <= 80


def test_rows_of_a_key_are_thinned_over_batches():
    import pyarrow as pa

    batches = [
        pa.RecordBatch.from_pydict({"k": k, "text": t})
        for k, t in [([1, 1, 2], ["a", "b", "c"]), ([], []), ([2, 3], ["d", "e"])]
    ]
    kept = [b.column("text").to_pylist() for b in neardup._without_repeats(iter(batches), ("k",))]
    assert [t for ts in kept for t in ts] == ["a", "c", "e"]

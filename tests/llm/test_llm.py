"""Contracts of the training-data operators against brute force, on small
frames with nulls, empty and long texts, ties, repeats and foreign columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from primrose.llm import ann, exact, langid, mixing, neardup, packing, quality, substring, urlfilter, warc
from primrose.llm.oracle import ORACLE
from primrose.llm.queries import HOST_RULES, QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    out = [(i, t, "en", "a", 1) for i, t in enumerate(base)]
    out += [(100 + i, t.upper() if i % 2 else t, "en", "b", 1) for i, t in enumerate(base[:6])]
    for i, t in enumerate(base[6:]):
        w = t.split()
        w[30] = "changed"
        out.append((200 + i, " ".join(w), None, "c", 1))
    passage = words(rng, 30, 5000)
    out += [(300 + i, words(rng, 20) + " " + passage + "\n" + words(rng, 20), "de", None, 1) for i in range(6)]
    out += [(400, None, "en", "a", 1), (401, "", "en", "a", 1), (402, " \n\t", "en", "a", 1)]
    out += [(403, "one two", "en", "a", 1), (404, "ONE  two", "en", "a", 1), (405, words(rng, 30_000), "en", "d", 1)]
    out += [(None, base[0], "en", "a", 1), (406, "É é Straße", "fr", "a", 1), (407, "é É Straße", "fr", "a", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns of other operators' names must not disturb.
    return (
        spark.createDataFrame(rows, DOCS)
        .withColumns({c: F.lit("x") for c in ("id", "node", "size", "kept", "keep_id", "__id", "grp", "score", "label")})
        .repartition(5)
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def split(t):
    return [w.decode() for w in (t or "").encode().split()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SMALL), SMALL, QUERIES[name], ORACLE[name]) == ""


def test_exact_groups(docs, rows, empty):
    got = exact.exact_groups(docs, keep="largest").collect()
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r[0])
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert exact.exact_groups(empty).count() == 0
    smallest = {r.doc_id for r in exact.exact_groups(docs).filter("kept").collect()}
    assert smallest == {min(i for i in ids if i is not None) for ids in groups.values()}


def test_exact_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "", "", 1)] * 3 + [(2, "A", "", "", 1)] * 2, DOCS)
    got = exact.exact_groups(df, keep="largest")
    assert got.filter("kept").count() == 1 and got.filter("group_size = 5 and keep_id = 2").count() == 5


def test_exact_hot_text(spark):
    """A text of most rows is dealt over parts and joined again."""
    df = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "Hot").otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact.exact_groups(df, keep="largest")
    assert got.filter("keep_id = 3999 and group_size = 4000").count() == 4000
    assert got.filter("kept").count() == 1001


def test_url_filter(spark):
    urls = [
        "http://a.NET/x", "http://net", "https://m.example.net/en/1", "http://example.com/de/", "http://x.org/fr/a?b",
        "http://adult-x.example.com/fr/", "http://notexample.com/de/", "ftp://casino/x", "nothing", "", None,
        "http://a.b/wp-login.php", "http://h.org/robots.txt?torrent=/torrent/", "http://k/?a://b", "http://net/" * 2000,
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, HOST_RULES)).collect()
    assert len(got) == len(urls) + 2
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("a.net", "/x", "net/", "block")
    want = [None, None, "example.net/en/", "example.com/de/", "org/fr/"] + [None] * 10
    want[0], want[14] = "net/", "net/"
    assert [by[i].rule for i in range(len(urls))] == want
    verdict = "block allow allow block allow block allow block allow allow allow block allow allow block".split()
    assert [by[i].verdict for i in range(len(urls))] == verdict
    rules = urlfilter.rule_table(spark, (), ("*", "@@||good.^"))
    some = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules).collect()}
    assert some[3] == "block" and some[8] == "allow"
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    again = {str(r) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert {str(r) for r in got} == again and len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: 1 + i % 3 for i, k in enumerate(order)}
    target, stopped, rest = {}, set(), sum(sizes.values())
    while True:
        live = [k for k in order if k not in stopped]
        share = rest / sum(weight[k] for k in live) if live else 0
        over = [k for k in live if share * weight[k] > 3 * sizes[k]]
        if not over:
            target |= {k: share * weight[k] for k in live}
            break
        for k in over:
            stopped.add(k)
            target[k] = 3 * sizes[k]
            rest -= 3 * sizes[k]
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        k = source[r.doc_id]
        assert math.isclose(r.target, target[k], rel_tol=1e-9) and r.source_size == sizes[k]
        assert r.taken == r.size * r.copies <= 3 * r.size
        assert r.copies in (int(r.target // r.source_size), int(r.target // r.source_size) + 1) or not r.size
        taken[k] = taken.get(k, 0) + r.taken
    largest = {k: max(r.size for r in got if source[r.doc_id] == k) for k in sizes}
    assert all(abs(taken[k] - target[k]) <= largest[k] / 2 + 1e-6 for k in sizes)
    assert mixing.mix_sources(empty).count() == 0


def test_weights_raise_the_chance(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 2).cast("string").alias("s"))
    df = df.withColumn("source", F.when(F.col("doc_id") < 1500, "big").otherwise("small"))
    got = mixing.mix_sources(df, weights=(1.0, 3.0), weight=F.when(F.col("s") == "1", 9.0).otherwise(1.0))
    big = got.filter("doc_id < 1500 and taken > 0")
    odd = big.filter("doc_id % 2 = 1").count()
    assert odd > 1.15 * (big.count() - odd)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), group_pieces=20).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    for doc, text, *_ in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values("piece")
        assert mine["length"].sum() == len(ids) and (mine["length"].iloc[1:] == 2048).all()
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_token_ids_of_odd_texts():
    ids = packing.TokenIds(tokenizer_path())
    rng = random.Random(1)
    alphabet = " \n\t a b'sé²½Ⅷ_9.,%|<>üñ  \x1c\r😀中́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    texts += ["", "<|endoftext|> a", "don't we'll"]
    assert ids.of(texts) == ids._slow(texts)


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)

    def least(sizes, room):
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] >= sizes[i]:
                    bins[b] -= sizes[i]
                    go(i + 1, bins)
                    bins[b] += sizes[i]
            go(i + 1, [*bins, room - sizes[i]])

        go(0, [])
        return best[0]

    for _ in range(60):
        sizes = [rng.randrange(2, 11) for _ in range(rng.randrange(1, 10))]
        packed = packing.bin_completion(sizes, 10)
        assert sorted(i for b in packed for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 10 for b in packed)
        assert len(packed) == least(sizes, 10)
    # Best fit decreasing needs three bins here; the search finds two.
    assert len(packing.best_fit([4, 4, 3, 3, 3, 3], 10)) == 3
    assert len(packing.bin_completion([4, 4, 3, 3, 3, 3], 10)) == 2


def test_search_reaches_the_last_bin_of_a_whole_group():
    """A group of 8,192 pieces in 2,389 bins, with full pieces before them."""
    sizes = [1028] * 1364 + [520] * 1025 + [510] * (2 * 1364 + 1025) + [509] * 2050
    assert len(sizes) == packing.GROUP_PIECES and len(packing.best_fit(sizes, 2048)) == 2646
    told = {}
    packed = packing.bin_completion([2048] * 300 + sizes, told=told)
    assert sorted(i for b in packed for i in b) == list(range(300 + len(sizes)))
    assert all(sum(([2048] * 300 + sizes)[i] for i in b) <= 2048 for b in packed)
    assert len(packed) == told["bins"] == told["least"] == 300 + 2389
    assert told["leaves"] and not told["cut"]
    # Fillings of very many pieces.
    assert len(packing.bin_completion([1500, 1500, 700, 700] + [1] * 1700, 2048)) == 3
    assert packing.completions([1], {1: 2000}, 1900, 6) == [(1,) * 1900]


def test_packing_tells_what_the_search_reached(spark):
    tally = spark.sparkContext.accumulator({}, packing.Tally())
    docs = spark.createDataFrame([(i, "a b c") for i in range(40)], "doc_id long, text string")
    packing.pack_documents(docs, tokenizer_path(), group_pieces=20, tally=tally).collect()
    assert tally.value["groups"] == 2 and tally.value["bins"] == tally.value["least"] == 2
    assert tally.value["reached"] == tally.value["searched"] == 0



def test_language_id(spark, docs, rows, empty):
    rng = random.Random(2)
    en, de = ["the", "thing", "that", "with"], ["der", "schach", "und", "ein"]
    make = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    model = langid.fit({"en": make(en, 400), "de": make(de, 400)})
    texts = [make(en, 9), make(de, 9), None, "", "123 %%%", "中", make(de, 3000).upper()]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)] + [(None, texts[0], "", "", 1)], DOCS)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"] and got[6].lang_pred == "de"
    assert got[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, model).count() == 0
    nothing = langid.fit(langid.training_texts(empty))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert set(langid.training_texts(docs)) == {"en", "de", "fr"}


def test_phrases_by_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        ref = "".join(rng.choice("ab ") for _ in range(40))
        model = langid.fit({"x": ref})
        known = " ".join(langid.letters_only(ref).split())
        text = "".join(rng.choice("abc") for _ in range(60))
        count, at = 0, 0
        while at < len(text):
            end = at
            while end < len(text) and text[at : end + 1] in known:
                end += 1
            at, count = max(end, at + 1), count + 1
        assert langid.phrase_counts([text, "a"], model)[0][0, 0] == count


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = QUERIES["op2_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.9 * got.count() > 0


def test_quality(spark, docs, rows, empty):
    good = [b"plain words of a text " * 20] * 40
    bad = [b"plain words " * 30 + b"||| %%% ### $$$ " * 60] * 40
    model = quality.fit(good + bad, [1] * 40 + [0] * 40, epochs=15)
    assert quality.score_texts([good[0], bad[0]], model).round() .tolist() == [1, 0]
    got = quality.score_quality(docs, model)
    assert got.count() == len(rows) and got.filter("score between 0 and 1").count() == len(rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.filter("predicted = 1").count()
    assert quality.score_quality(empty, model).count() == 0
    assert quality.fit([], []).mean.shape == (quality.DIMENSIONS,)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 0)], "doc_id long, quality int")
    texts, marks = quality.training_rows(docs, labels)
    assert len(texts) == len(marks) <= 2


def test_quality_gradient():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, 900).astype(np.uint8)) for _ in range(4)]
    x, first = quality.passages(texts)
    w = {k: v + 0.05 for k, v in quality.fit([], []).w.items()}
    y = np.array([0.0, 1.0, 1.0, 0.0])
    loss = lambda w: -(np.log(np.where(y == 1, p := quality._forward(x, first, w)["y"], 1 - p))).mean()
    g = quality._gradient(x, first, w, y, 0.0)
    for k in ("E", "V", "U", "a", "c"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert math.isclose((loss(up) - loss(down)) / 2e-5, g[k][at], rel_tol=1e-3, abs_tol=1e-8)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op6_quality_score"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got) > 0


def removed(rows, window=13):
    owner, texts = {}, [(math.inf if r[0] is None else r[0], split(r[1])) for r in rows]
    for doc, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            owner[k] = min(owner.get(k, doc), doc)
    out = []
    for doc, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if doc == math.inf else doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("groups", [1, 7])
def test_substring(docs, rows, empty, groups):
    got = substring.duplicate_spans(docs, groups=groups, removed_text=True).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == removed(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring.duplicate_spans(empty).count() == 0


def test_substring_repeated_rows(spark):
    rows = [(5, words(random.Random(1), 40), "", "", 1)] * 3
    assert [r.n_removed for r in substring.duplicate_spans(spark.createDataFrame(rows, DOCS)).collect()] == [0] * 3


def components_of(rows):
    sets = []
    for _, t, *_ in rows:
        w = split(lowered(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(str((rows[i][0], len(sets[i]), least.get(r))) for i, r in enumerate(root))


@pytest.mark.parametrize("limit", [None, 4])
def test_near_duplicates(docs, rows, empty, monkeypatch, limit):
    """With small limits regions go deeper and clusters meet block by block."""
    if limit:
        monkeypatch.setattr(neardup, "BLOCK_ROWS", limit)
    got = neardup.near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == components_of(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    if limit is None:
        assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 10)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "", "", 1))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == components_of(rows)


def test_near_duplicates_of_large_regions(spark, monkeypatch):
    """Copies that are near to their base only, in regions of many blocks."""
    monkeypatch.setattr(neardup, "REGION_ROWS", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "", "", 1)]
    for i in range(1, 80):
        w = list(base)
        for at in range(20, 200, 40):
            w[at + rng.randrange(-15, 15)] = f"x{i}"
        rows.append((i, " ".join(w), "", "", 1))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == components_of(rows)
    assert {r.component_id for r in got} == {0}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[40:400] = x[40]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] + [1.0] * 15)]
    bad += [(2100, [1.0, 2.0]), (None, [1.0] * 16), (2120, [float("inf")] * 16)]
    df = spark.createDataFrame(data + bad + data[:3], "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    queries = range(0, 1500, 20)
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(queries)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s.round(9)))[:20]
        mine = sorted(by[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(math.isclose(v, x[i] @ x[q], rel_tol=1e-12) for _, i, v in mine)
        hits += len({i for _, i, _ in mine} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(queries)
    # Among equal vectors the smaller ids come first.
    assert [i for _, i, _ in sorted(by[40])] == list(range(41, 61))
    few = ann.nearest(df.filter("vec_id < 5"), F.col("vec_id") == 0, k=20)
    assert [r["rank"] for r in few.collect()] == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "long " * 400
    pages = [(1, "http://a/\r\nb", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "")]
    pages += [(None, "n", big), (7, "x", "é" * 200_000), (2, None, big)]
    pages += [(100 + i, "http://a", f"<html>{i} " + "body " * 50) for i in range(150)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit(1))
    where = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(warc.plan_records(df.coalesce(2)), where, archive_bytes=4_000)
    assert manifest.count() > 1
    got = warc.read_archives(manifest).collect()
    want = []
    for number, url, html in pages:
        body = (html or "").encode()
        revisit = body == big.encode() and number != 2
        want.append(
            (number, url and url.replace("\r", "%0D").replace("\n", "%0A"), "revisit" if revisit else "response",
             2 if revisit else None, len(body), hashlib.sha1(body).hexdigest(), None if revisit else body)
        )
    flat = lambda r: str((*r[:6], r[6] and hashlib.md5(bytes(r[6])).hexdigest()))
    assert sorted(map(flat, want)) == sorted(map(flat, got))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_refuses_broken_archives(tmp_path):
    good = warc.record_bytes(1, "u", b"body", hashlib.sha1(b"body").hexdigest(), False, None)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodi"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    archive = warc._Archive(f"file://{tmp_path}", [good] * 10)
    archive.add(good)
    archive.add(good)
    path, _, _ = archive.close()
    assert list(warc.frames(path)) == [good, good]
    file = path.removeprefix("file://")
    data = open(file, "rb").read()
    for cut in (data[:-3], data[4:], data[:6]):
        open(file, "wb").write(cut)
        with pytest.raises((warc.WarcError, Exception)):
            list(warc.frames(path))


def test_pipeline_stages(spark):
    """Each stage of the pipeline, on what the one before kept, by brute force."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in p.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        docs = p.kept_table(stage(spark, docs, SMALL), "t")
        assert docs.columns == columns
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "exact":
            groups = {}
            for r in before:
                groups[lowered(r[1])] = max(groups.get(lowered(r[1]), r[0]), r[0])
            assert ids == sorted(groups.values())
        if name == "near":
            kept = {eval(c)[2] for c in components_of(before)}
            assert ids == sorted(kept)
        after[name] = ids
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len([i for i in good if i in after["quality"]]) >= 0.9 * len(good)  # 70 rows to learn from
    packed = p.packing_stage(spark, docs, SMALL)
    assert sorted(r.doc_id for r in packed.filter("piece = 0").collect()) == after["mixing"]


def test_pipeline_stages_decide_on_rows(spark):
    """Null and repeated ids: a decision belongs to its row."""
    import corpus_pipeline as p

    rng = random.Random(9)
    a, b, c, d, e = (words(rng, 60, 5000) for _ in range(5))
    near = " ".join(["other", *b.split()[1:]])
    # id, text, name of the row: exact copies under one id, a loser whose id has
    # another row that stays, unique and equal texts without an id.
    rows = [(1, a, "a1"), (1, a, "a2"), (2, b, "b2"), (1, b.upper(), "b1"), (1, c, "c1"), (None, d, "d"), (None, d, "d'")]
    rows += [(None, c, "c"), (None, e, "e"), (3, near, "n3"), (2, near + " x", "n2"), (None, near + " y", "n"), (4, None, "z")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")

    def names(df):
        return sorted(r.source for r in df.collect())

    exact_kept = names(p.exact_stage(spark, docs.coalesce(1), SMALL))
    assert exact_kept == sorted(["a2", "b2", "c1", "d'", "e", "n3", "n2", "n", "z"])
    # Groups: a; b and all n (b1 has the least id); c; d; e; z.
    assert names(p.near_stage(spark, docs.coalesce(1), SMALL)) == sorted(["a1", "b1", "c1", "d", "e", "z"])
    one = docs.withColumn("name", F.col("source")).withColumn("source", F.lit("s"))
    mix = mixing.mix_sources(one.withColumn("r", F.monotonically_increasing_id()), weights=(1.0,), row_col="r")
    assert {r.copies for r in mix.collect() if r["size"]} == {1}
    taken = p.mixing_stage(spark, one, SMALL)
    assert sorted(r.name for r in taken.collect()) == sorted(n for _, t, n in rows if t)

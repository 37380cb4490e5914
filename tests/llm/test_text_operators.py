import hashlib
import os
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("readloom.llm")
from readloom.llm import _words, decontaminate, encoders, near_dup, packing, quality_model, quality_rules, sharding, substring_dedup, token_counts, token_files, url_filter  # noqa: E402
from readloom.llm._graph import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n_words long, rid string, shard int, words string"
LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def prose(r, n, end="."):
    out = []
    for i in range(n):
        w = "".join(r.choice(["th", "er", "on", "an", "re", "é", "st"]) for _ in range(r.randint(1, 5)))
        out.append(w + (end if i % 9 == 8 else ""))
    return "".join(w + ("\n" if i % 31 == 30 else " ") for i, w in enumerate(out)).strip()


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    r = random.Random(1)
    long = prose(r, 30_000)
    texts = [(None, None), (None, "one two"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same same"), (5, "same same"), (6, "same same"), (7, "<|endoftext|> a  b\u00a0c"), (8, "x" * 5000), (9, "a\n" * 500), (10, prose(r, 60))]
    return spark.createDataFrame([(i, t, "en", 1, "q", 0, "w") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- words ---------------------------------------------------------------------------------------------------


def test_words_match_regular_expression():
    r = random.Random(2)
    texts = ["".join(r.choice("aZ9 -\né日\x80\x00_{") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(_words.chunks(iter([batch]), most=200))
    assert sum(p.num_rows for p in parts) == len(texts)
    at = 0
    for p in parts:
        w = _words.words_of(p.column(0))
        h = w.hashes()
        for i in range(p.num_rows):
            a, b = w.first[i], w.first[i + 1]
            want = words(texts[at + i])
            assert [w.low[x:y].tobytes().decode() for x, y in zip(w.begin[a:b], w.end[a:b])] == want
            assert len(set(h[a:b].tolist())) == len(set(want))
        grams, place = w.grams(h, 3)
        assert all(w.doc[x] == w.doc[x + 2] for x in place)
        assert len(grams) == sum(max(0, len(words(t)) - 2) for t in texts[at : at + p.num_rows])
        at += p.num_rows


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- token counts, token files, packing ------------------------------------------------------------------------


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoders.vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "a  b", "a\n\nb", " a", "a ", "don't I'll we've", "é ́x", "ΣΑΣ Σ", "a\tb", "foo<|endoftext|>bar<|startoftext|>.", "end.)' x's.", "日本 語。", "a\u00a0b c", "w,. ! ?", "\x1f a", "A.B,c.!! x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    r = random.Random(4)
    texts = TRICKY + [prose(r, 40, r.choice([".", "!!", "%%%", ","])) for _ in range(60)] + ["".join(r.choice("ab .,'\n!é<|>") for _ in range(60)) for _ in range(200)]
    want = [library(name)(t) for t in texts]
    enc = encoders.Encoder(encoders.vocabulary(name), 50)
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_sentencepiece_encoder():
    import sentencepiece

    path = encoders.vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = encoders.Encoder(path)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(TRICKY)] == lib.encode(TRICKY)


def test_token_counts_and_cache(spark, edge, nothing, tmp_path):
    path, cache = encoders.vocabulary("byte_bpe_50k.json"), str(tmp_path / "cache")
    ids = library("byte_bpe_50k.json")
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(ids(r["text"])), n > 512) for r in edge.collect())
    for _ in range(2):  # the second time all texts are in the cache
        got = token_counts.count_tokens(edge, path, cache).collect()
        assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == edge.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_counts.count_tokens(edge, encoders.vocabulary("word_bpe_49k.json"), cache).count()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(nothing, path, str(tmp_path / "none")).count() == 0


def test_elias_fano():
    r = random.Random(5)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (5, 3), (1000, 10), (1000, 10**6), (3000, 10**13)):
        v = sorted(r.randint(0, top) for _ in range(n))
        e, at = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(v).to_bytes())
        assert e.decode().tolist() == v and [e[i] for i in range(n)] == v
        if n >= 1000:
            bits = 8 * at / n
            assert bits < 4 + max(0, np.log2(max(top, 1) / n)) + 1
        with pytest.raises(IndexError):
            e[n]


@pytest.mark.parametrize("segment_ids", [50, 1 << 20])
def test_token_files_round_trip(spark, edge, nothing, tmp_path, segment_ids):
    ids = library("byte_bpe_50k.json")
    path = str(tmp_path / "t")
    token_files.write_token_files(edge, encoders.vocabulary("byte_bpe_50k.json"), path, segment_ids=segment_ids)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order) and len(rows) == edge.count()
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 0
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    want = sorted([(r["doc_id"] or -1, ids(r["text"]) + [0]) for r in edge.collect()])
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == want
    one = token_files.Segment(spark.read.parquet(path).orderBy("part", "number").first()["data"])
    assert one.doc_id(0) is None and one.tokens(0)[-1] == 0
    token_files.write_token_files(nothing, encoders.vocabulary("byte_bpe_50k.json"), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_packing(spark, edge, nothing):
    ids = library("word_bpe_49k.json")
    path = encoders.vocabulary("word_bpe_49k.json")
    rows = packing.pack(edge, path, 512).collect()
    full = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        data = np.frombuffer(r["ids"], "<u4")
        assert len(data) == r["length"] <= 512 and r["start"] == 512 * r["piece"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        full.setdefault(r["doc_id"] or -1, []).extend(data.tolist())
    want = {}
    for r in edge.collect():
        want.setdefault(r["doc_id"] or -1, []).append(ids(r["text"]) + [0])
    assert {k: sorted(v) for k, v in full.items()} == {k: sorted(sum(v, [])) for k, v in want.items()}
    check_bins(rows, 512)
    assert packing.pack(nothing, path).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_plan_is_close_to_the_bound_and_complete():
    r = random.Random(6)
    for trial in range(30):
        sizes = [r.randint(1, 100) if trial % 3 else r.choice([34, 35, 51, 67, 100]) for _ in range(400)]
        hist = {n: sizes.count(n) for n in set(sizes)}
        plan = packing.plan_bins(hist, 100)
        used = {}
        for lengths, bins in plan:
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] = used.get(n, 0) + bins
        assert used == hist
        bins, free = 0, []
        for n in sorted(sizes, reverse=True):  # first fit decreasing
            k = next((i for i, f in enumerate(free) if f >= n), None)
            if k is None:
                free.append(100 - n)
            else:
                free[k] -= n
        assert sum(b for _, b in plan) <= len(free) * 1.02
    assert packing.plan_bins({}, 10) == []
    # two smaller documents replace the smallest one where they fill the gap
    assert sorted(packing.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0][0]) == [15, 25, 60]


# -- url filter ---------------------------------------------------------------------------------------------------


URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.Example.NET/en/1?x=/fr/", "http://example.net/enx", "http://example.net/en", "https://xexample.net/en/",
    "http://example.com/de/", "http://sub.example.com/de/q#f", "http://example.com?/de/", "http://www.example.org/fr/x", "http://org/fr", "ftp://a.b.org/fr/", "x://example.net:80/en/", "http://.net/a", "a://b://net/",
]


def brute_verdict(url, rules):
    host, path = url_filter.split_url(url)
    fits = [(h.count("."), len(p), a == "allow", h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_url_filter(spark, tmp_path):
    more = [*url_filter.RULES, ("block", "example.net", "/en/p"), ("block", "a.example.net", ""), ("allow", "a.example.net", ""), ("block", "example.com", "/de/q")]
    pages = spark.createDataFrame([(i, u, "h", "keep") for i, u in enumerate(URLS * 2)], "page_id int, url string, host string, other string")
    for rules in (url_filter.RULES, more):
        for most in (1000, 1):
            got = url_filter.filter_urls(pages, rules, max_trie_rules=most).collect()
            assert len(got) == 2 * len(URLS)
            for r in got:
                h, p = url_filter.split_url(URLS[r["page_id"] % len(URLS)])
                assert (r["host"], r["path"], r["other"]) == (h, p, "keep")
                assert (r["rule"], r["verdict"]) == brute_verdict(URLS[r["page_id"] % len(URLS)], rules), (URLS[r["page_id"] % len(URLS)], most)
    frame = spark.createDataFrame(more, "action string, host string, path string")
    assert url_filter.filter_urls(pages, frame).where("verdict = 'block'").count() == url_filter.filter_urls(pages, frame, max_trie_rules=2).where("verdict = 'block'").count()
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).count() == 0


# -- sharding -----------------------------------------------------------------------------------------------------


def test_sharding(spark, edge, nothing, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(997)], "doc_id long, text string")
    rows = sharding.shard_digest(docs, 7, bucket_bytes=2000).collect()
    again = sharding.shard_digest(docs.repartition(3), 7, bucket_bytes=2000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(f"text {r['doc_id'] % 50}".encode()) and r["law"] == "rows"
    assert {r["doc_id"] for r in rows} == set(range(997)) and set(by) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {len(s) for s in by.values()} <= {142, 143}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(997))[0, 1]) < 0.15
    # bucket, order inside it, permutation and shard, made anew
    buckets = max(-(-sum(len(f"text {i % 50}") + 16 for i in range(997)) // 2000), 4)
    key = F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text"))
    told = docs.select("doc_id", F.pmod(F.xxhash64(key, F.lit(0).cast("long")), F.lit(buckets)).cast("int").alias("b")).collect()
    whole = []
    for b in range(buckets):
        own = sorted(x["doc_id"] for x in told if x["b"] == b)
        whole += [own[i] for i in sharding.fisher_yates(len(own), 17, b)]
    assert order == whole
    path = sharding.write_shards(edge, 3)
    back = spark.read.parquet(path)
    assert back.count() == edge.count() and {"lang", "slot", "shard", "words", "shard_"} <= set(back.columns)
    left, right = ([tuple(x) for x in t.select("doc_id", "text", "lang", "n_words", "rid").collect()] for t in (back, edge))
    assert sorted(map(str, left)) == sorted(map(str, right))
    clash = docs.limit(20).withColumns({c: F.lit(1) for c in ("key", "bucket", "place", "number", "b__")})
    assert sharding.shard_digest(nothing, 4).count() == 0 and spark.read.parquet(sharding.write_shards(clash, 2)).select(*clash.columns).distinct().count() == 20


def test_sharding_of_hot_rows(spark):
    """100,000 rows without id and text and 20,000 of one id: no bucket is much larger than others."""
    rows = spark.range(0, 120_000, 1, 4).select(F.when(F.col("id") >= 100_000, F.lit(5).cast("long")).alias("doc_id"), F.when(F.col("id") >= 100_000, F.col("id").cast("string")).alias("text"))
    keyed = sharding._numbered(rows.withColumn("key", F.xxhash64("doc_id", "text")), "key", "number")
    sizes = [x["count"] for x in keyed.groupBy(F.pmod(F.xxhash64("key", "number"), F.lit(60)).alias("b")).count().collect()]
    assert len(sizes) == 60 and max(sizes) < 1.5 * 2000
    got = sharding.shard_digest(rows, 9, bucket_bytes=50_000).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    assert len(got) == 9 and all((x["n"], x["a"], x["b"], x["d"]) == (x["n"], 0, x["n"] - 1, x["n"]) and x["n"] in (13333, 13334) for x in got)


# -- quality --------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, edge, nothing):
    r = random.Random(7)
    good = prose(r, 200)
    rows = [
        (1, good), (2, good + "\nHome | News | About | Contact\nplease accept cookies now.\n%%% ### $$$\nMenu"), (3, "a b c. " * 60), (4, "\n".join(["the same line again and again here."] * 12)),
        (5, "word " * 49), (6, good + "\n" + "\n".join(f"a | b{i} | c | d{i}" for i in range(300))),
    ]
    got = {x["doc_id"]: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["cleaned"] == good and got[1]["n_bad_lines"] == 0
    assert got[2]["kept"] and got[2]["n_bad_lines"] == 4 and got[2]["cleaned"] == good
    assert got[3]["base_failed"] and got[3]["n_repeat_words"] == 180 and got[4]["n_dup_lines"] == 11 and got[5]["base_failed"]
    assert not got[6]["base_failed"] and not got[6]["kept"]
    for x in edge.select("doc_id", "text").collect():
        t = x["text"] or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        grams = {}
        for i in range(len(ws) - 2):
            grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
        hit = {p + k for g in grams.values() if len(g) > 1 for p in g for k in range(3)}
        if x["doc_id"] in (1, 2, 3, 4, 8, 9, 10):
            y = quality_rules.judge(edge.where(F.col("doc_id") == x["doc_id"])).first()
            assert (y["n_words"], y["word_chars"], y["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(hit))
    assert quality_rules.judge(edge).count() == edge.count() and quality_rules.judge(edge).where("kept").count() == 2
    assert quality_rules.judge(nothing).count() == 0


def test_quality_model(spark, edge, nothing):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, prose(r, 80, "%%%" if bad else ".").upper() if bad else prose(r, 80)))
        labels.append((i, 0 if bad else 1, 0))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, told).collect()
    held = [x for x in got if x["held_out"]]
    assert held and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    assert sum(x["predicted"] == (x["doc_id"] % 5 != 0) for x in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    # held-out labels have no influence
    flipped = told.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {x["doc_id"]: x["score"] for x in quality_model.classify(docs, flipped).collect()}
    assert all(abs(other[x["doc_id"]] - x["score"]) < 1e-12 for x in got)
    kept = quality_model.accept(docs.withColumn("words", F.lit(1)).withColumn("x", F.lit("y")), told)
    assert kept.columns == ["doc_id", "text", "words", "x"] and kept.where("doc_id % 5 = 0").count() == 0 and kept.count() >= 310
    assert quality_model.classify(edge, told).count() == edge.count() and quality_model.classify(nothing, told).count() == 0
    none = quality_model.classify(docs.limit(3), told.limit(0)).collect()
    assert {round(x["score"], 9) for x in none} == {0.7}
    a, b = quality_model.learn(np.array([[1.0], [2.0], [3.0], [9.0]]), np.array([0, 0, 1, 1])), quality_model.learn(np.array([[3.0], [1.0]]), np.array([0, 1]))
    assert a.weights[0] > 0 > b.weights[0]


DATA = Path(os.environ.get("READLOOM_TESTDATA", "/root/testdata/sf0.01"))


def test_quality_vectors_match_brute_force(spark, edge):
    """Shares and buckets of every text made anew, the score from them, and the fit by plain descent."""
    rows = edge.select("doc_id", "text").collect()
    texts = [x["text"] or "" for x in rows]
    got = quality_model.grams(pa.array([x["text"] for x in rows], pa.string()))
    for t, v in zip(texts, got):
        raw, three = t.encode(), np.zeros(64)
        for i in range(len(raw) - 2):
            three[((raw[i] * 961 + raw[i + 1] * 31 + raw[i + 2]) * 2654435761 % 2**32) >> 26] += 1
        assert np.allclose(v[64:], three / max(len(raw) - 2, 1)) and np.isclose(v[:64].sum(), 1.0 if words(t) else 0.0)
    one = {t: g for t, g in zip(texts, got)}
    assert np.allclose(quality_model.grams(pa.array(texts[::-1]))[::-1], got) and np.allclose(one["same same"][:64].max(), 1)
    r = np.random.default_rng(3)
    x, y = r.normal(size=(80, 6)), (r.random(80) < 0.6).astype(int)
    x[y == 1, 2] += 1
    model = quality_model.learn(x, y, l2=1e-2)
    z = (x - x.mean(0)) / x.std(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = len(good) * len(bad)
    rng = np.random.default_rng(7)
    d = z[good[rng.permutation(np.arange(n) % len(good))]] - z[bad[rng.permutation(np.arange(n) % len(bad))]]
    w = np.zeros(6)
    for _ in range(4000):
        w += 0.5 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 2e-2 * w)
    assert np.allclose(model.weights * x.std(0), w, atol=1e-4)
    raw = x @ model.weights + model.bias
    assert (raw >= np.log(0.7 / 0.3)).sum() == len(good)  # the cut leaves as many as are labelled good


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_quality_model_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    right = sum(x["predicted"] == x["quality"] for x in got)
    good, bad = ([x["score"] for x in got if x["quality"] == q] for q in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert right >= 0.95 * len(got) and auc >= 0.98, (right / len(got), auc, len(got))


# -- near duplicates ----------------------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_corpus(seed=9):
    r = random.Random(seed)
    rows = []
    for g in range(12):
        base = prose(r, r.randint(60, 160)).split(" ")
        for k in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(k if g % 2 else 2 * k):
                t[r.randrange(len(t))] = "edit%d" % r.randint(0, 99)
            rows.append(" ".join(t))
    rows += ["one two three", "One, two three!", "four", None, "", "...", rows[0], rows[0]]
    return rows


def brute_near(texts):
    sets = [shingles(t) for t in texts]
    n, links, root = len(texts), [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return links, [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [128, 2])
def test_near_classes_match_brute_force(spark, block):
    texts = near_corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    links, roots = brute_near(texts)
    got = {r["doc_id"]: r for r in near_dup.near_classes(docs, block=block).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == dict(enumerate(links))
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(roots))
    assert {i: r["class_size"] for i, r in got.items()} == {i: roots.count(x) for i, x in enumerate(roots)}
    if block == 128:
        kept = near_dup.keep_one(docs.withColumn("n", F.lit(1)))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots)) and kept.columns == ["doc_id", "text", "n"]


def test_near_edges(spark, edge, nothing):
    got = near_dup.near_classes(edge)
    assert got.count() == edge.count() and near_dup.near_classes(nothing).count() == 0
    assert got.where("doc_id IN (5, 6)").select("class_id", "class_size", "n_links").distinct().collect()[0][:] == (5, 3, 2)
    kept = near_dup.keep_one(edge)
    assert kept.where("doc_id IN (5, 6)").count() == 1 and kept.count() == edge.count() - 2 and kept.columns == edge.columns
    assert near_dup.keep_one(nothing).count() == 0
    same = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "A b c d e f g"), (None, "p q r s t u v"), (None, "p q, r s t u v")], "doc_id long, text string")
    assert sorted(x["text"] for x in near_dup.keep_one(same).collect()) in (["A b c d e f g", "p q r s t u v"], ["A b c d e f g", "p q, r s t u v"])
    assert near_dup.floor_for(0.8, 16, recall=0.999) == 4 and near_dup.floor_for(0.8, 16, recall=0.9) > 4


def test_join_node_hangs_together_what_brute_force_does():
    r = np.random.default_rng(1)
    for _ in range(60):
        k = int(r.integers(3, 40))
        sketch = r.integers(0, 256, (3, 128)).astype(np.uint8)[r.integers(0, 3, k)].copy()
        for i in range(k):
            m = int(r.integers(0, 90))
            sketch[i, r.integers(0, 128, m)] = r.integers(0, 256, m)
        near = (sketch[:, None] == sketch[None]).sum(-1) >= 80
        want, got = np.arange(k), np.arange(k)
        for _ in range(k):
            want = np.array([want[near[i]].min() for i in range(k)])
        for a, b in near_dup.join_node(sketch, sketch[:, :8], 80, 4):
            assert near[a, b]
            low, high = sorted((got[a], got[b]))
            got[got == high] = low
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_weak_links_are_not_closed_over(spark):
    """A chain of texts of which each shares a third with the next: no candidate group, whatever the closure would be."""
    r = random.Random(12)
    parts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"{parts[i]} {parts[i + 1]}") for i in range(299)], "doc_id long, text string")
    signed = near_dup.signatures(docs, 16, 2)  # a floor so low that such texts meet in many nodes
    shared = signed.select(F.explode("nodes").alias("n")).groupBy("n").count().where("count > 1").count()
    joins = near_dup.candidates(signed.select("set_id", "nodes", "sketch"), 16, 8, 0.8, 2, 4)
    assert shared > 50 and joins.count() == 0
    assert {x["class_size"] for x in near_dup.near_classes(docs).collect()} == {1}


def test_large_nodes_are_dealt_over_parts(spark):
    r = random.Random(13)
    base = [f"w{r.randrange(10**9)}" for _ in range(200)]
    rows = [(i, " ".join([*base[: r.randrange(199)], f"x{i}", *base[199:]]) if i % 3 == 0 else " ".join([*base[:190], *[f"y{r.randrange(10**9)}" for _ in range(5)]])) for i in range(60)]
    signed = near_dup.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 16, 4).select("set_id", "nodes", "sketch")
    groups = []
    for most in (4096, 7):
        edges = near_dup.candidates(signed, 16, 8, 0.8, 4, 4, most)
        groups.append({(x["node"], x["component"]) for x in components(edges).collect()})
    assert groups[0] == groups[1] and groups[0]


# -- repeated passages --------------------------------------------------------------------------------------------------------


def test_window_minima_and_compact_windows():
    r = np.random.default_rng(1)
    v = r.integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 7, 46, 300):
        assert substring_dedup.window_minima(v, width).tolist() == [int(v[i : i + width].min()) for i in range(300 - width + 1)]
    grams, doc = r.integers(0, 1 << 62, 400).astype(np.uint64), np.repeat([0, 1, 2], [150, 30, 220])
    key, left, centre, right = substring_dedup.compact_windows(grams, doc, 46, 1)
    covered = [x for a, b in zip(left, right) for x in range(a, b - 44)]
    assert covered == [*range(105), *range(180, 355)] and (left <= centre).all() and (centre <= right).all() and (right - left >= 45).all()
    # nodes of the tree: reaching further on a side would meet a smaller hash, another text, or more than 45 tokens
    value = {int(g): int(k) for g, k in zip(grams[centre], key)}
    assert len(value) == len(key) and (centre - left <= 45).all() and (right - centre <= 45).all()
    again = substring_dedup.compact_windows(np.concatenate([grams[:100], grams[180:300]]), np.repeat([0, 1], [100, 120]), 46, 1)[0]
    assert set(again.tolist()) & set(key.tolist())


def passage_corpus(seed=10):
    r = random.Random(seed)
    shared, near = prose(r, 70), prose(r, 90).split(" ")
    texts = [prose(r, r.randint(5, 300)) for _ in range(25)]
    for i in range(0, 25, 4):
        texts[i] = f"{prose(r, 40)} {shared} {prose(r, 30)}"
    texts[1] += " " + " ".join(near)
    near[40] = "changed"
    texts[2] = " ".join(near) + " " + texts[2]
    return [*texts, texts[3] if len(words(texts[3])) >= 50 else shared, None, "", shared[: len(shared) // 3]], shared


@pytest.mark.parametrize("split", [5000, 2])
def test_passages_match_brute_force(spark, split):
    texts, shared = passage_corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ws = [words(t) for t in texts]
    where = {}
    for i, w in enumerate(ws):
        for j in range(len(w) - 49):
            where.setdefault(tuple(w[j : j + 50]), set()).add(i)
    exact = {(i, p) for i, w in enumerate(ws) for j in range(len(w) - 49) if len(where[tuple(w[j : j + 50])]) > 1 for p in range(j, j + 50)}
    got = substring_dedup.report(docs, split=split).collect()
    found = {(r["doc_id"], p) for r in got for p in range(r["begin_word"], r["end_word"])}
    assert exact <= found
    assert {i for i, _ in found} == {i for i, _ in exact} | {1, 2}
    clean = {i: t for i, t in map(tuple, substring_dedup.cut(docs, split=split).collect())}
    held = [i for i, t in clean.items() if " ".join(words(shared)) in " ".join(words(t))]
    assert len(held) == 1
    untouched = set(range(len(texts))) - {i for i, _ in found}
    assert all(clean[i] == texts[i] for i in untouched)
    again = substring_dedup.report(spark.createDataFrame(list(clean.items()), "doc_id long, text string")).count()
    assert again == 0


def alike_windows(a, b, width=46):
    """Matrix of pairs of starts whose windows are alike as sets, by 2-d prefix sums if no token repeats."""
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        total = np.zeros((len(a) + 1, len(b) + 1), int)
        total[1:, 1:] = (np.array(a)[:, None] == np.array(b)[None, :]).cumsum(0).cumsum(1)
        both = total[width:, width:] - total[:-width, width:] - total[width:, :-width] + total[:-width, :-width]
        return both * 5 >= 4 * (2 * width - both)
    sets = [[set(c[x : x + width]) for x in range(len(c) - width + 1)] for c in (a, b)]
    return np.array([[len(s & t) * 5 >= 4 * len(s | t) for t in sets[1]] for s in sets[0]])


def test_alike_is_exact():
    """All starts of a candidate run, with tokens put in, left out, changed and repeated, against sets."""
    r = np.random.default_rng(2)
    for trial in range(150):
        few = trial % 3 == 0  # many repeated tokens
        a = r.integers(0, 40 if few else 1 << 62, 140).tolist()
        b = list(a)
        for _ in range(int(r.integers(0, 6))):
            at, kind = int(r.integers(0, len(b))), int(r.integers(0, 3))
            b[at : at + (kind > 0)] = [int(r.integers(0, 1 << 62))] * (kind < 2)
        e = int(r.integers(-3, 4))
        x0, x1 = max(0, -e), min(len(a), len(b) - e) - 46
        one = [np.array([v]) for v in (x0, x1, x0 + e)]
        k, x = substring_dedup.alike(np.array(a, np.uint64), np.array(b, np.uint64), *one, 46, 4, 5)
        want = [i for i in range(x0, x1 + 1) if len(set(a[i : i + 46]) & set(b[i + e : i + e + 46])) * 5 >= 4 * len(set(a[i : i + 46]) | set(b[i + e : i + e + 46]))]
        assert x.tolist() == want and not k.any()


def test_interval_join_matches_brute_force():
    r = np.random.default_rng(4)
    n, width = 60, 46
    centre, centre2 = r.integers(60, 160, (2, n))
    left, right = centre - r.integers(0, 46, n), centre + r.integers(0, 46, n)
    left2, right2 = centre2 - r.integers(0, 46, n), centre2 + r.integers(0, 46, n)
    ok = (right - left >= 45) & (right2 - left2 >= 45)
    pair = np.sort(r.integers(0, 4, n))
    rows = [c[ok] for c in (pair, left, centre, right, left2, centre2, right2)]
    got = substring_dedup.interval_join(rows[0], substring_dedup._pack(*rows[1:4]), substring_dedup._pack(*rows[4:]), np.ones(len(rows[0]), np.int64), width)
    found = {(p, e, x) for p, e, a, b in zip(*(c.tolist() for c in got)) for x in range(a, b + 1)}
    want, cases = set(), list(zip(*(c.tolist() for c in rows)))
    for p in range(4):
        for e in {q[5] - q[2] for q in cases if q[0] == p}:
            for x in range(200):
                held = sum(q[1] <= x <= q[3] - 45 and q[4] <= x + e <= q[6] - 45 for q in cases if q[0] == p and abs(q[5] - q[2] - e) <= substring_dedup.NEAR)
                if held >= substring_dedup.AGREE:
                    want.add((p, e, x))
    assert found == want and want


def changed(r, ws, n, kind):
    """``ws`` with ``n`` words put in, left out or changed, anywhere."""
    out = list(ws)
    for j in sorted(r.sample(range(len(ws)), n), reverse=True):
        out[j : j + (kind != "in")] = [] if kind == "out" else [f"n{r.randrange(10**9)}"]
    return out


@pytest.mark.parametrize("size, n, kind", [(60, 1, "in"), (60, 2, "in"), (60, 2, "out"), (60, 1, "other"), (100, 4, "out"), (100, 3, "in"), (200, 6, "other")])
def test_recall_of_changed_passages(spark, size, n, kind):
    """Pairs of texts around a passage and its changed copy: windows found against all pairs of windows."""
    r = random.Random(size + n)
    fill = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    texts = []
    for _ in range(60):
        core = fill(size)
        texts += [[*fill(r.randint(0, 60)), *core, *fill(r.randint(0, 60))], [*fill(r.randint(0, 60)), *changed(r, core, n, kind), *fill(r.randint(0, 60))]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for x in substring_dedup.report(docs).collect():
        found.setdefault(x["doc_id"], set()).update(range(x["begin_word"], x["end_word"]))
    held = pairs = covered = total = 0
    for i in range(0, len(texts), 2):
        a, b = ([hash(tuple(t[j : j + 5])) for j in range(len(t) - 4)] for t in texts[i : i + 2])
        if min(len(a), len(b)) < 46:
            continue
        near = alike_windows(a, b)
        want = [{p for x in np.flatnonzero(near.any(axis)).tolist() for p in range(x, x + 50)} for axis in (1, 0)]
        for k in (0, 1):
            assert found.get(i + k, set()) <= want[k]  # nothing but passages
            covered, total = covered + len(want[k] & found.get(i + k, set())), total + len(want[k])
        pairs, held = pairs + near.any(), held + (near.any() and i in found)
    assert pairs >= 10 and held >= 0.98 * pairs and covered >= 0.95 * total, (held, pairs, covered, total)


def test_passages_behind_a_frequent_line(spark):
    """A line of 40 words in all texts, and pairs of texts that share 52 words around it, against brute force."""
    r = random.Random(31)
    fill = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, texts = fill(40), []
    for _ in range(60):
        texts.append([*fill(30), *line, *fill(30)])
    for _ in range(40):
        held = [*fill(6), *line, *fill(6)]
        texts += [[*fill(30), *held, *fill(30)] for _ in range(2)]
    where = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 49):
            where.setdefault(tuple(t[j : j + 50]), set()).add(i)
    exact = {(i, p) for i, t in enumerate(texts) for j in range(len(t) - 49) if len(where[tuple(t[j : j + 50])]) > 1 for p in range(j, j + 50)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.report(docs).collect()
    found = {(x["doc_id"], p) for x in got for p in range(x["begin_word"], x["end_word"])}
    assert len(exact) == 80 * 52 and exact <= found and {i for i, _ in found} == {i for i, _ in exact}


def test_passage_edges(spark, edge, nothing):
    assert substring_dedup.report(nothing).count() == 0 and substring_dedup.cut(nothing).count() == 0
    out = substring_dedup.cut(edge)
    assert out.columns == edge.columns and out.count() == edge.count()  # no passage of 50 words repeats
    r = random.Random(3)
    long = prose(r, 80)
    copies = spark.createDataFrame([(None, long), (7, long), (3, long), (9, long.replace(".", "!"))], "doc_id long, text string")
    kept = substring_dedup.cut(copies).collect()
    assert sum(len(words(x["text"])) for x in kept) == 80
    only = spark.createDataFrame([(7, long), (3, long)], "doc_id long, text string")
    assert [x["doc_id"] for x in substring_dedup.cut(only).collect()] == [3]
    assert sorted((x["doc_id"], x["kept"]) for x in substring_dedup.report(only).collect()) == [(3, True), (7, False)]


# -- decontamination -------------------------------------------------------------------------------------------------------------


def brute_leaks(text, items):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        b = words(t)
        k = min(10, len(b))
        for j in range(len(b) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[j : j + k]:
                    hit |= set(range(i, i + k))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("max_bytes", [8 << 20, 120])
def test_decontamination_matches_brute_force(spark, max_bytes):
    r = random.Random(11)
    items = [(i, prose(r, r.randint(8, 30))) for i in range(8)] + [(20, "Short item"), (21, None), (22, "..."), (100, None)]
    items.append((9, items[0][1] + " more words"))
    texts = [None, "", "short ITEM here", "a short, item?"] + [prose(r, 40) for _ in range(6)]
    texts += [f"{prose(r, 9)} {' '.join(t.split()[:k])} {prose(r, 9)}" for _, t in items[:8] for k in (9, 10, 15)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for x in decontaminate.report(docs, bench, max_bytes=max_bytes).collect():
        n, hit, names = brute_leaks(texts[x["doc_id"]], items)
        assert (x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) == (n, hit, len(names), hit > 0), x
        assert x["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    for how in ("documents", "spans"):
        out = decontaminate.clean(docs, bench, how, max_bytes=max_bytes)
        assert out.columns == docs.columns and decontaminate.report(out, bench).where("contaminated").count() == 0
        assert out.count() == (docs.count() if how == "spans" else sum(not brute_leaks(t, items)[1] for t in texts))


def test_decontamination_edges(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "same same"), (None, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.report(edge, bench).where("contaminated").collect()}
    assert got == {(5, 2, 1), (6, 2, 1), (None, 2, 0)}
    assert decontaminate.report(nothing, bench).count() == 0 and decontaminate.report(edge, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(edge, bench).count() == edge.count()


def test_spans_are_merged_like_one_by_one():
    r = np.random.default_rng(1)
    n = 400
    rid, role, begin, partner = r.integers(0, 5, n), r.integers(0, 2, n), r.integers(0, 3000, n), r.integers(0, 99, n)
    end = begin + r.integers(50, 90, n)
    out = substring_dedup._merged(rid, role, begin, end, begin * 6, end * 6, partner)
    want = set()
    for key in {(int(a), int(b)) for a, b in zip(rid, role)}:
        now = None
        for s, t, q in sorted((int(begin[i]), int(end[i]), int(partner[i])) for i in range(n) if (rid[i], role[i]) == key):
            if now and s <= now[1]:
                now = (now[0], max(now[1], t), min(now[2], q))
            else:
                want |= {(*key, *now)} if now else set()
                now = (s, t, q)
        want.add((*key, *now))
    assert {tuple(map(int, x)) for x in zip(*out[:4], out[6])} == want and (out[4] == out[2] * 6).all() and (out[5] == out[3] * 6).all()


def test_windows_of_texts_in_large_groups_are_few_rows(spark):
    """A passage that many texts share costs a row for each text and task, not one for each of its windows."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 1 << 40, n))
    common = word(300)
    docs = spark.createDataFrame([(i, f"{word(60)} {common} {word(60)}") for i in range(60)], "doc_id long, text string").repartition(2)
    known = docs.select(F.xxhash64("text").alias("rid"), "text")
    parts = 3
    first = substring_dedup.seeds(known, 46, 5, substring_dedup.FUNCTIONS, parts)
    deep = first.where(f"kind = {substring_dedup._DEEP}").select("rid", "more").localCheckpoint()
    assert 60 <= deep.count() <= 60 * (parts + 1)
    assert deep.agg(F.sum(F.length("more")) / 16).first()[0] > 60 * 20
    assert substring_dedup.deeper(deep, known, 46, 5, parts).count() < 60 * 12
    words = {i: set() for i in range(60)}
    for x in substring_dedup.report(docs).collect():
        words[x["doc_id"]] |= set(range(x["begin_word"], x["end_word"]))
    assert all(w >= set(range(60, 360)) for w in words.values())


def test_repeated_tokens_need_memory_in_proportion():
    """Texts of few tokens that come again and again: occurrences meet in ranges, not each with each in its reach."""
    import tracemalloc

    a = np.tile(np.arange(1, 4, dtype=np.uint64), 4000)
    b = a.copy()
    b[::40] = 9  # no window is equal
    one = [np.array([v]) for v in (0, len(a) - 46, 0)]
    tracemalloc.start()
    k, x = substring_dedup.alike(a, b, *one, 46, 4, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(x) and peak < 1000 * len(a), peak / len(a)


def test_marked_starts_mark_what_all_comparisons_mark():
    """Starts that are skipped or accepted early leave the marked windows of both texts of each pair as they are."""
    r = np.random.default_rng(12)
    skipped = 0
    for trial in range(80):
        few = trial % 3 == 0
        a, b, runs = [], [], []
        for row in range(3):
            own = r.integers(0, 30 if few else 1 << 62, int(r.integers(60, 160))).tolist()
            mate = list(own)
            for _ in range(int(r.integers(0, 7))):
                at, kind = int(r.integers(0, len(mate))), int(r.integers(0, 3))
                mate[at : at + (kind > 0)] = [int(r.integers(0, 1 << 62))] * (kind < 2)
            for e in range(-6, 7):
                x0, x1 = max(0, -e), min(len(own), len(mate) - e) - 46
                if x0 <= x1:
                    runs.append((row, len(a) + x0, len(a) + x1, len(b) + x0 + e))
            a, b = a + own, b + mate
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        row, x0, x1, y0 = (np.array(c) for c in zip(*runs))
        first = [substring_dedup._firsts(c, 46) for c in (a, b)]
        k, x = substring_dedup.alike(a, b, x0, x1, y0, 46, 4, 5)
        k2, x2 = substring_dedup.marked_starts(a, b, *first, row, x0, x1, y0, 46, 4, 5)
        every, some = set(zip(k.tolist(), x.tolist())), set(zip(k2.tolist(), x2.tolist()))
        k3, x3 = substring_dedup.possible(a, b, *first, x0, x1, y0, 46, 4, 5)
        assert some <= every <= set(zip(k3.tolist(), x3.tolist())) and len(some) == len(x2)
        sides = lambda s: ({(row[i], p) for i, p in s}, {(row[i], y0[i] + p - x0[i]) for i, p in s})
        assert sides(some) == sides(every)
        skipped += len(every) - len(some)
    assert skipped


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_cache_keeps_frequent_pieces(name):
    """Pieces that come again are encoded once however many others pass through the cache; all ids are the library's."""
    from tokenizers import Tokenizer

    r = random.Random(5)
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha()]
    texts = [" ".join([f"often{k}" for k in range(5)] + ["".join(r.choices(letters, k=r.randint(1, 9))) + r.choice(["", "", ",", "7"]) for _ in range(20)]) for _ in range(60)]
    texts += [f"{a}\n{b} {a}{b}" for a in letters for b in "xÉß"]
    path = encoders.vocabulary(name)
    enc, library = encoders.Encoder(path, 400), Tokenizer.from_file(path)
    given, call = [], enc._library
    enc._library = lambda batch: given.extend(batch) or call(batch)
    got = [np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() for t in texts]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert "\n".join(given).count("often3") <= 2  # with a space before it or none
    assert len(enc.known) + len(enc.older) <= 400 + 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_are_encoded_many_in_a_call(name):
    """The library is called for groups of new pieces, not for each; all ids are the library's."""
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÉÖßéøÿ"
    texts = [" ".join("".join(r.choices(letters, k=r.randint(4, 9))) + r.choice(["", ",", ".'"]) for _ in range(100)) for _ in range(30)]
    want = list(map(library(name), texts))
    enc, calls = encoders.Encoder(encoders.vocabulary(name)), []

    def count(frame, event, f):
        if event == "c_call" and type(getattr(f, "__self__", None)).__module__.startswith("tokenizers"):
            calls.append(f)

    sys.setprofile(count)
    try:
        got = enc.encode(texts)
    finally:
        sys.setprofile(None)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == want
    assert len(calls) <= 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_end_where_tokens_end(name, monkeypatch):
    """Any mix of letters, marks, digits, signs, white space and special strings, in groups of any size."""
    r = random.Random(8)
    some = [*"abtsSreé×÷ÿßÀªµΣ日Жя0٣.,'!<=|̸́​ \u0085　\x1c\t\r\x00\x7f", "'s", "'re", "🙂", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(r.choice(some[: r.choice([9, 30, len(some)])] + [" ", "\n"]) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(a + b + c for a in "é×ÿ日5'") for b in ".'é" for c in ["", " ", "s"]]
    want = list(map(library(name), texts))
    for most in (1, 200, 1 << 20):
        monkeypatch.setattr(encoders, "GROUP_CHARS", most)
        enc = encoders.Encoder(encoders.vocabulary(name), 300)
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_slices_of_texts_are_whole_and_bounded():
    texts = [None, "", "é" * 30, None, "x" * 500, "a", "b", *["cc"] * 90]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(97)), pa.array(texts, kind)], ["doc_id", "text"])
        got = list(encoders.text_lists(iter([batch, batch.slice(0, 0), batch.slice(3)]), 100))
        assert [t for _, part in got for t in part] == [t or "" for t in texts + texts[3:]]
        assert [i for rows, _ in got for i in rows.column(0).to_pylist()] == [*range(97), *range(3, 97)]
        assert all(rows.num_rows == len(part) for rows, part in got)
        assert all(len("".join(part[1:]).encode()) < 100 for _, part in got) and len(got) == 7

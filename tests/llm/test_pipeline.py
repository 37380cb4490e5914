"""The corpus pipeline against brute-force versions of its stages, on small tables."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("readloom.llm")
import corpus_pipeline  # noqa: E402
from readloom.llm import encoders, substring_dedup  # noqa: E402

from .test_text_operators import brute_leaks, brute_near, check_bins, prose, words  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    passage, item = prose(r, 70), prose(r, 25)
    rows, labels = [], []
    for i in range(160):
        t = prose(r, r.randint(60, 200))
        if i % 8 == 0:
            t = t.upper().replace(" ", "%%% ")
        elif i % 8 == 1 and i > 8:
            base = rows[i - 8][1].split(" ")
            base[3] = "edited"
            t = " ".join(base)
        elif i % 20 == 2:
            t = f"{t} {passage} {prose(r, 20)}"
        elif i % 20 == 5:
            t = f"{t} {' '.join(item.split()[:14])} {prose(r, 20)}"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if i % 8 == 0 else 1, 0))
    rows += [(200, None, "en", "s", 0), (None, prose(r, 90), "en", "s", 1), (201, "", None, None, None), (7, rows[7][1], "en", "s", 2)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item, passage


def test_stages(spark, tables):
    d, item, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, d)
    kept = good.collect()
    assert good.columns == columns
    assert not [x for x in kept if x["doc_id"] is not None and x["doc_id"] % 8 == 0 and x["doc_id"] < 160 and "%%%" in x["text"]]
    assert {x["doc_id"] for x in kept if x["doc_id"] is not None} >= {i for i in range(160) if i % 8}

    one = stages["near_duplicates"](spark, good, d)
    order = sorted(kept, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0))
    _, roots = brute_near([x["text"] for x in order])
    worded = [i for i, x in enumerate(order) if words(x["text"])]
    want = sorted(str(order[roots[i]]["doc_id"]) for i in worded if roots[i] == i) + sorted(str(x["doc_id"]) for x in order if not words(x["text"]))
    assert sorted(str(x["doc_id"]) for x in one.collect()) == sorted(want) and one.columns == columns

    cut = stages["repeated_passages"](spark, one, d)
    rows = cut.collect()
    assert cut.columns == columns and sum(" ".join(words(passage)) in " ".join(words(x["text"])) for x in rows) == 1
    assert all(x["n_chars"] == len(x["text"]) for x in rows if x["text"] is not None)
    assert substring_dedup.report(cut).count() == 0

    clean = stages["benchmark_leaks"](spark, cut, d)
    assert clean.columns == columns
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(x["doc_id"]) for x in rows if not brute_leaks(x["text"], [(1, item)])[1])

    pieces = stages["packed"](spark, clean, d).collect()
    assert check_bins(pieces, 2048) <= -(-sum(x["length"] for x in pieces) // 2048) + 1
    enc = encoders.Encoder(encoders.vocabulary("word_bpe_49k.json"))
    for x in clean.collect():
        own = sorted((p for p in pieces if p["doc_id"] == x["doc_id"]), key=lambda p: p["piece"])
        ids = np.append(np.frombuffer(enc.encode([x["text"] or ""])[0], enc.dtype), 0).astype("<u4")
        assert [p["ids_crc32"] for p in own] == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]


def test_run_and_empty_tables(spark, tables, tmp_path):
    d, *_ = tables
    assert corpus_pipeline.run(spark, d).count() > 0
    e = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{e}/{t}.parquet")
    assert corpus_pipeline.run(spark, e).count() == 0

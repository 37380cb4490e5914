"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training texts.

A window is ``n`` consecutive words of a benchmark item; an item with fewer words, but not none, is
one window. Training texts are scanned whole: hashes of their word windows are looked up in the
set, every hit is verified on the exact words, and all words inside verified windows are hit.

The set is broadcast only while the benchmark has at most ``MAX_BYTES`` of text (about 15 times
that in memory); the scan is then narrow. Of a larger one nothing is broadcast or gathered: windows of
texts and items meet in an equi-join on their hashes, and only texts with hits are verified.

Null and empty texts have no words and no hits. Items with a null id hit but are not named. Items
that share a window are all named; repeated rows are judged alike; an empty benchmark hits nothing
and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, dropped, stored, unused
from ._words import Words, chunks, words_of

WINDOW = 10
MAX_BYTES = 8 << 20
_FLAG_BITS = 22


@dataclass
class WindowSet:
    """Windows by word count: sorted hashes, a bit filter in front, and exact words to item ids."""

    n: int
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    flags: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[bytes, list[str]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple], n: int) -> WindowSet:
        out, found = cls(n), {}
        w = words_of(pa.array([t for _, t in rows], pa.string()))
        h = w.hashes()
        for (item, _), a, b in zip(rows, w.first[:-1].tolist(), w.first[1:].tolist()):
            k = min(n, b - a)
            for at in range(a, b - k + 1) if k else ():
                names = out.items.setdefault(w.key(at, k), [])
                if item is not None and str(item) not in names:
                    names.append(str(item))
            if k and k < n:
                found.setdefault(k, []).append(cls._grams(w, h, a, b, k))
        found.setdefault(n, []).append(w.grams(h, n)[0])
        for k, parts in found.items():
            hashes = np.unique(np.concatenate(parts))
            flags = np.zeros(1 << _FLAG_BITS, bool)
            flags[hashes & np.uint64((1 << _FLAG_BITS) - 1)] = True
            if len(hashes):
                out.hashes[k], out.flags[k] = hashes, flags
        return out

    @staticmethod
    def _grams(w: Words, h: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
        one = Words(w.raw, w.low, w.begin[a:b], w.end[a:b], w.doc[a:b], w.first, w.offset)
        return one.grams(h[a:b], k)[0]

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the item ids found in each text."""
        h = w.hashes()
        step = np.zeros(len(h) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for k, table in self.hashes.items():
            grams, at = w.grams(h, k)
            may = np.flatnonzero(self.flags[k][grams & np.uint64((1 << _FLAG_BITS) - 1)])
            place = np.searchsorted(table, grams[may])
            may = may[table[np.minimum(place, len(table) - 1)] == grams[may]]
            for word in at[may].tolist():
                names = self.items.get(w.key(word, k))
                if names is not None:
                    step[word] += 1
                    step[word + k] -= 1
                    items.setdefault(int(w.doc[word]), set()).update(names)
        return np.cumsum(step[:-1]) > 0, items


def _spans(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the runs of hit words, cut at text ends."""
    edge = np.ones(len(hit) + 1, bool)
    edge[1:-1] = (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(edge)
    keep = hit[cut[:-1]] if len(hit) else np.zeros(0, bool)
    return cut[:-1][keep], cut[1:][keep]


def _held(benchmark: DataFrame, n: int, max_bytes: int) -> WindowSet | None:
    """The window set of a benchmark that is small enough to be broadcast."""
    bench = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return WindowSet.build([tuple(r) for r in bench.collect()], n) if size <= max_bytes else None


_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _hits(w: Words, hit: np.ndarray, items: list) -> pa.Array:
    """The hit words and the item ids of each text as ``_KIND``."""
    first, last = _spans(hit, w.doc)
    flat: list[list[int]] = [[] for _ in range(len(items))]
    for d, x, y in zip(w.doc[first].tolist(), first.tolist(), last.tolist()):
        flat[d] += [int(w.begin[x] - w.offset[d]), int(w.end[y - 1] - w.offset[d]), y - x]
    return pa.array([{"n_words": c, "spans": s, "items": i} for c, s, i in zip(np.diff(w.first).tolist(), flat, items)], _KIND)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_bytes: int = MAX_BYTES, name: str = "hits") -> DataFrame:
    """``docs`` with a column ``name``: struct(n_words, spans, items).

    ``spans`` are flat byte positions (begin, end, words) of the UTF-8 text, disjoint and ascending.
    """
    held = _held(benchmark, n, max_bytes)
    if held is None:
        return _scan_joined(docs, benchmark, n, name)
    windows, names = docs.sparkSession.sparkContext.broadcast(held), docs.columns
    at = names.index("text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words_of(b.column(at))
            hit, items = windows.value.scan(w)
            yield pa.RecordBatch.from_arrays([*b.columns, _hits(w, hit, [sorted(items.get(i, ())) for i in range(b.num_rows)])], [*names, name])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField(name, _HITS)]))


def _windows(batches: Iterator[pa.RecordBatch], n: int, sizes: list[int] | None) -> Iterator[pa.RecordBatch]:
    """(id, word, k, hash, key) of all windows of texts of k words: each of ``sizes``, or the item's own."""
    for b in chunks(batches, "text", 1 << 19):
        w = words_of(b.column(1))
        h = w.hashes()
        size = np.diff(w.first)
        for k in sizes or range(1, n + 1):
            grams, at = w.grams(h, k)
            if sizes is None:  # shorter windows are items of that many words
                keep = size[w.doc[at]] == k if k < n else np.ones(len(at), bool)
                grams, at = grams[keep], at[keep]
            key = [w.key(i, k) for i in at.tolist()] if sizes is None else [None] * len(at)
            rows = [b.column(0).take(pa.array(w.doc[at])), pa.array(at - w.first[w.doc[at]]), pa.array(np.full(len(at), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(key, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["id", "word", "k", "hash", "key"])


def _scan_joined(docs: DataFrame, benchmark: DataFrame, n: int, name: str) -> DataFrame:
    """``scan`` by joins: windows of texts and items on their hashes, then hits and items back to the texts."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where(F.col("text").isNotNull())
    items = stored(bench.mapInArrow(lambda batches: _windows(batches, n, None), "id string, word long, k int, hash long, key binary"), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # n at most
    text_id, = unused(docs.columns, "text_id")
    texts = docs.select(F.xxhash64("text").alias("id"), "text").where(F.col("text").isNotNull())
    found = texts.mapInArrow(lambda batches: _windows(batches, n, sizes or [n]), "id long, word long, k int, hash long, key binary")
    # windows of several items are one row; copies of a text are one text
    keys = items.select("k", "hash", "key").distinct()
    found = stored(found.select("id", "word", "k", "hash").join(keys, ["k", "hash"]).select("id", "word", "k", "hash", "key").distinct(), "found")
    words = found.groupBy("id").agg(F.collect_list(F.struct("word", "k", "key")).alias("at"))
    whole = texts.dropDuplicates(["id"]).join(words, "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words_of(b.column(1))
            rows = []
            for i, (own, at) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                rows += [(own, x["word"], x["k"], x["key"]) for x in at if w.key(int(w.first[i]) + x["word"], x["k"]) == x["key"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["id", "word", "k", "key"])

    sure = stored(whole.select("id", "text", "at").mapInArrow(verify, "id long, word long, k int, key binary"), "sure")
    named = sure.select("id", "k", "key").distinct().join(items.select("k", "key", F.col("id").alias("item")), ["k", "key"])
    named = named.where("item IS NOT NULL").select("id", "item").distinct().groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    place = sure.groupBy("id").agg(F.collect_list(F.struct("word", "k")).alias("at"))
    told = stored(place.join(named, "id", "left").select(F.col("id").alias(text_id), F.struct("at", "items").alias(name)), "told")
    dropped(items, found, sure)
    joined = docs.withColumn(text_id, F.xxhash64("text")).join(told, text_id, "left").select(*map(col, docs.columns), name)
    names, at = docs.columns, docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words_of(b.column(at))
            step, ids = np.zeros(len(w.begin) + 1, np.int64), []
            for i, x in enumerate(b.column(len(names)).to_pylist()):
                ids.append((x and x["items"]) or [])
                for y in (x and x["at"]) or ():
                    step[w.first[i] + y["word"]] += 1
                    step[w.first[i] + y["word"] + y["k"]] -= 1
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], _hits(w, np.cumsum(step[:-1]) > 0, ids)], [*names, name])

    return joined.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(name, _HITS)]))


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    h = scan(docs.select("doc_id", "text"), benchmark, n, max_bytes)
    return h.select(
        "doc_id", F.col("hits.n_words").alias("n_words"),
        F.expr("aggregate(filter(hits.spans, (x, i) -> i % 3 = 2), 0L, (s, x) -> s + x)").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit spans.

    Cutting a span leaves a line feed in its place; a cut text is cut again until no window is left.
    """
    names = docs.columns
    hits, = unused(names, "hits")
    if remove == "documents":
        return scan(docs, benchmark, n, max_bytes, hits).where(F.size(F.col(hits)["spans"]) == 0).select(*map(col, names))
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    at = names.index("text")

    def without(w: Words, texts: list[bytes], first, last) -> list[int]:
        """Cut the spans [first, last) of words out of ``texts``; the texts that were changed."""
        done = []
        for d, x, y in list(zip(w.doc[first].tolist(), first.tolist(), last.tolist()))[::-1]:
            o = w.offset[d]
            texts[d] = texts[d][: w.begin[x] - o] + b"\n" + texts[d][w.end[y - 1] - o :]
            done.append(d)
        return sorted(set(done))

    held = _held(benchmark, n, max_bytes)
    if held is not None:
        windows = docs.sparkSession.sparkContext.broadcast(held)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                texts = b.column(at).to_pylist()
                todo = [i for i, t in enumerate(texts) if t]
                while todo:
                    w = words_of(pa.array([texts[i] for i in todo], pa.string()))
                    raw = [texts[i].encode() for i in todo]
                    again = without(w, raw, *_spans(windows.value.scan(w)[0], w.doc))
                    for d in again:
                        texts[todo[d]] = raw[d].decode()
                    todo = [todo[d] for d in again]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))], names)

        return docs.mapInArrow(cut, docs.schema)

    def cut_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, x in enumerate(b.column(len(names)).to_pylist()):
                raw = (texts[i] or "").encode()
                for k in range(len(x["spans"]) - 3, -1, -3):
                    raw = raw[: x["spans"][k]] + b"\n" + raw[x["spans"][k + 1] :]
                texts[i] = raw.decode() if x["spans"] else texts[i]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))], names)

    while True:  # a cut can bring a new window about; each round shortens the texts it changes
        told = stored(scan(docs, benchmark, n, max_bytes, hits), "told")
        if not told.where(F.size(F.col(hits)["spans"]) > 0).limit(1).count():
            return told.select(*map(col, names))
        docs = told.mapInArrow(cut_once, docs.schema)

"""Quality classifier by Bradley-Terry pairwise ranking.

Each text becomes a fixed vector: shares of symbols, capitals, digits, punctuation, repeated lines and words,
and lengths, made by built-in column functions, and the shares of its words and of its byte trigrams in hashed
buckets, made by one Arrow pass, which also scores. A linear score is learned from preference pairs (a good and a bad labelled text) by logistic loss on feature differences. The
score cut is a quantile of the training scores, the share of bad labels among them; raw scores are
mapped so that this cut falls on 0.7 and every score lies in (0, 1).

Only labelled rows outside the held-out fold are learned from, and of these at most
``MAX_ROWS`` (lowest seeded hash; the driver then holds MAX_ROWS x 148 numbers) and ``MAX_PAIRS``
pairs. Scoring is one narrow pass over every whole text.

Null and empty texts have the features of an empty text and are scored like any other. Null doc_ids
are scored but never learned from; null labels are ignored; repeated label rows count repeatedly.
Without labels of both kinds every text gets score 0.7. Tied scores stay tied. An empty table gives
an empty result. Other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, pinned
from ._words import chunks, words_of

MAX_ROWS = 20_000
MAX_PAIRS = 200_000
CUT = 0.7
#: Shares made by column functions, then buckets of words and of byte trigrams.
N_SHARES, N_BUCKETS = 20, 64
N_FEATURES = N_SHARES + 2 * N_BUCKETS
#: Penalty on the squared weights of the shares and of the buckets.
L2_SHARES, L2_BUCKETS = 1e-3, 1e-2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = "0123456789"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(chars: str) -> str:
    """Characters of ``t`` in a class: all others are removed, several times faster than translate()."""
    return f"length(regexp_replace(t, '[^{chars}]+', ''))"


def grams(texts: pa.Array) -> np.ndarray:
    """Shares of each text's words (64 hashed buckets), then of its byte trigrams (64 more); 0 for texts without any."""
    w = words_of(texts)
    n = len(texts)
    word = np.bincount(w.doc * N_BUCKETS + (w.hashes() >> np.uint64(58)).astype(np.int64), minlength=n * N_BUCKETS).reshape(n, N_BUCKETS)
    size = np.diff(w.offset)
    if len(w.raw) >= 3:
        raw = w.raw.astype(np.uint32)
        code = ((raw[:-2] * np.uint32(961) + raw[1:-1] * np.uint32(31) + raw[2:]) * np.uint32(2654435761)) >> np.uint32(26)
        doc = np.repeat(np.arange(n), size)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        three = np.bincount(doc[inside] * N_BUCKETS + code[inside], minlength=n * N_BUCKETS).reshape(n, N_BUCKETS)
    else:
        three = np.zeros((n, N_BUCKETS))
    return np.concatenate([word / np.maximum(np.diff(w.first), 1)[:, None], three / np.maximum(size - 2, 1)[:, None]], 1)


def vectors(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of the columns ``keep`` and their whole feature vectors, from rows of ``features``."""
    for b in chunks(batches, "t", 1 << 19):
        x = b.column(len(keep) + 1)
        shares = x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_SHARES)
        yield pa.RecordBatch.from_arrays(b.columns[: len(keep)], keep), np.concatenate([shares, grams(b.column(len(keep)))], 1)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``t``, the text, and ``x``, its shares."""
    c = "greatest(length(t), 1)"
    w, n = "size(words)", "greatest(size(words), 1)"
    full = "greatest(size(lines), 1)"
    parts = [
        f"{_count('#*$%&')} / {n}", f"{_count('|<>')} / {n}", f"{_count('!')} / {n}", f"{_count('?')} / {n}",
        f"{_count('.,')} / {n}", f"{_count('A-Z')} / {c}", f"{_count('0-9')} / {c}", f"{_count('@_/=')} / {n}",
        f"{_count(';:()-')} / {n}", f"{_count('{}"')} / {n}", f"ln(1 + {w})", f"length(t) / {n} / 10",
        f"size(array_distinct(words)) / {n}", f"ln({n}) * size(array_distinct(words)) / {n} / 5",
        f"(size(lines) - size(array_distinct(lines))) / {full}", f"ln(1 + {n} / {full})",
        f"least({w}, 50) / 50", f"(octet_length(t) - length(t)) / {c}",
        f"size(array_distinct(transform(words, (x, i) -> xxhash64(x, words[greatest(i - 1, 0)])))) / {n}",
        f"greatest(length(t) - 20000, 0) / 100000",
    ]
    base = docs.select(*keep, F.expr("coalesce(text, '')").alias("t"))
    words = pinned(F.expr(r"array_remove(split(replace(t, '\n', ' '), ' '), '')"))
    lines = pinned(F.expr(r"array_remove(split(t, '\n'), '')"))
    base = base.withColumns({"words": words, "lines": lines})
    return base.select(*keep, "t", F.array(*[F.expr(p).cast("double") for p in parts]).alias("x"))


@dataclass
class Ranker:
    """A linear score over features: ``score = sigmoid(bias + weights . x)``."""

    weights: np.ndarray
    bias: float

    def score(self, rows: DataFrame, keep: list[str], least: float | None = None) -> DataFrame:
        """``keep`` and ``score`` of rows of ``features``; with ``least`` only rows of at least that score."""
        weights, bias = self.weights, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, x in vectors(batches, keep):
                score = 1 / (1 + np.exp(-np.clip(bias + (x * weights).sum(1), -30, 30)))
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*keep, "score"])
                yield out if least is None else out.filter(pa.array(score >= least))

        return rows.mapInArrow(run, T.StructType([*rows.select(*keep).schema.fields, T.StructField("score", T.DoubleType())]))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7, max_pairs: int = MAX_PAIRS, l2: np.ndarray | float | None = None) -> Ranker:
    """Bradley-Terry: minimise the mean of log(1 + exp(-w.(good - bad))) + l2 w^2 by Newton steps."""
    width = x.shape[1] if x.ndim == 2 else 0
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), float(np.log(CUT / (1 - CUT))))
    if l2 is None:
        l2 = np.where(np.arange(width) < N_SHARES, L2_SHARES, L2_BUCKETS)
    l2 = np.broadcast_to(l2, width)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 1.0
    z = (x - mean) / sd
    # every row takes part: rows of the rarer label are dealt round, not drawn
    a = good[rng.permutation(np.arange(n) % len(good))]
    b = bad[rng.permutation(np.arange(n) % len(bad))]
    w = np.zeros(width)
    for _ in range(25):
        curve, slope = 2 * np.diag(l2), -2 * l2 * w
        for k in range(0, n, 20_000):  # differences are made in parts, so that few are held
            d = z[a[k : k + 20_000]] - z[b[k : k + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            curve += (d * (p * (1 - p))[:, None]).T @ d / n
            slope += d.T @ p / n
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.sort(raw)
    k = len(bad)  # the cut is the quantile of the share of bad rows, midway to the next score
    cut = (order[k - 1] + order[min(k, len(order) - 1)]) / 2
    return Ranker(w / sd, float(np.log(CUT / (1 - CUT)) - cut - (mean / sd) @ w))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 7) -> Ranker:
    """Learn from the labelled rows of ``docs`` outside the held-out fold, ``max_rows`` at most."""
    told = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    told = told.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    few = told.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality").limit(max_rows)
    rows = features(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), ["doc_id", "quality"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in vectors(batches, ["doc_id", "quality"]):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["doc_id", "quality", "x"])

    made = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(whole, "doc_id string, quality int, x array<double>")
    # a doc_id that many rows share would make the sample unbounded: at most max_rows rows come back
    got = made.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality", "x").limit(max_rows).select("quality", "x").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    return learn(x, got["quality"].to_numpy().astype(int), seed)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = fit(docs, labels, max_rows).score(features(docs, ["doc_id"]), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that the classifier predicts to be good."""
    names = docs.columns
    packed = docs.select(F.struct(*map(col, names)).alias("row"), F.col("text").alias("text"))
    good = fit(docs, labels, max_rows).score(features(packed, ["row"]), ["row"], CUT)
    return good.select(*[F.col("row").getField(c).alias(c) for c in names])

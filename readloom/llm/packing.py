"""Best-two-fit packing of token pieces into sequences of fixed capacity.

Texts are encoded, an end id is appended, and only documents longer than the capacity are cut. The
plan is made on the histogram of piece lengths, which has at most ``capacity`` entries however
large the corpus is: a bin takes the longest piece left and is filled greedily with the longest
that fits; then its smallest piece is replaced by two unpacked pieces that fill the widened gap
more tightly, if there are such. A bin pattern is repeated as often as its lengths last, so every
step uses up a length and the plan stays small. Pieces find their place by their rank among the
pieces of equal length: ranks are counted in salted groups, so a length that a third of all pieces
share is spread over many tasks.

A null or empty text is one piece holding the end id alone. Null ids and repeated rows are packed
like any other row. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import extended, shuffle_parts, stored
from .encoders import encoder, text_lists


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): ``ids`` are little-endian unsigned 32-bit."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for rows, texts in text_lists(batches):
            names, piece, start, length, crc, data = [], [], [], [], [], []
            for name, ids in zip(rows.column(0).to_pylist(), enc.encode(texts)):
                wide = np.frombuffer(ids + end, enc.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(wide), capacity)):
                    part = wide[at : at + capacity].tobytes()
                    names.append(name)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    data.append(part)
            columns = [pa.array(x, t) for x, t in ((names, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (data, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, how many such bins)], using up the whole histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    plan = []
    while lengths:
        used: dict[int, int] = {}
        free = lambda n: left[n] - used.get(n, 0)
        take = lambda n, k=1: used.__setitem__(n, used.get(n, 0) + k)
        take(lengths[-1])
        gap = capacity - lengths[-1]
        i = bisect.bisect_right(lengths, gap) - 1
        while i >= 0 and gap:
            n = lengths[i]
            k = min(free(n), gap // n)
            if k:
                take(n, k)
                gap -= k * n
            i = min(i - 1, bisect.bisect_right(lengths, gap) - 1)
        if gap and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            room, best = gap + small, (small, None)
            i, j = 0, bisect.bisect_right(lengths, room) - 1
            while i <= j:
                a, b = lengths[i], lengths[j]
                if a + b > room:
                    j -= 1
                    continue
                fits = free(b) >= 1 and free(a) >= (2 if a == b else 1)
                if fits and a + b > best[0]:
                    best = (a + b, (a, b))
                if not free(b):
                    j -= 1
                else:
                    i += 1
            for n in best[1] or (small,):
                take(n)
        used = {n: k for n, k in used.items() if k}
        bins = min(left[n] // k for n, k in used.items())
        plan.append(([n for n, k in sorted(used.items(), reverse=True) for _ in range(k)], bins))
        for n, k in used.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
    return plan


def _lookup(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys, with what to add to a rank to get its bin, and the place in the bin."""
    key, shift, place, used, first = [], [], [], {}, 0
    for lengths, bins in plan:
        at = 0
        for n in lengths:
            rank = used.get(n, 0)
            key.append((n << 44) | rank)
            shift.append(first - rank)
            place.append(at)
            used[n] = rank + bins
            at += n
        first += bins
    order = np.argsort(np.asarray(key, np.int64), kind="stable")
    return tuple(np.asarray(x, np.int64)[order] for x in (key, shift, place))


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs doc_id, piece, length and ids_crc32."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * shuffle_parts(pieces))).alias("salt__")
    salted = pieces.withColumn("salt__", salt)
    counts = salted.groupBy("length", "salt__").agg(F.count("*").alias("n__"))
    before = Window.partitionBy("length").orderBy("salt__").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("base__"))
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(_lookup(plan_bins(histogram, capacity)))
    inside = Window.partitionBy("length", "salt__").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("in__", F.row_number().over(inside) - 1).join(base, ["length", "salt__"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("base__") + F.col("in__")).alias("rank__"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shift, offset = table.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank__"))
            at = np.searchsorted(key, (length << 44) | rank, "right") - 1
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rank + shift[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, extended(pieces, sequence_id="long", offset="long"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Every piece with its sequence and place. Encoded pieces are written once, to the shared folder."""
    pieces = stored(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return assign(pieces if with_ids else pieces.drop("ids"), capacity)

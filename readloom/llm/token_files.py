"""Token-id files: one concatenated id array with Elias-Fano encoded document boundaries.

Documents are put in ascending id order (nulls first, equal ids by a digest, then text), encoded, and
written as segments of about ``SEGMENT_IDS`` ids. A segment is one binary value:

    magic "RLT1", width of an id, documents, ids, ids before it in its partition, null ids, lowest id,
    Elias-Fano of the boundaries, Elias-Fano of (id - lowest id), the ids (little-endian).

Elias-Fano keeps n non-decreasing numbers below u in about n * (2 + log2(u / n)) bits; the sampled
select structure finds the i-th without decoding the rest, so there is no 64-bit offset table.
Segments are rows of a Parquet table in a folder, so any store that Spark writes to can hold them.
When reading, only one 64-bit start for each partition is made on the driver.

An empty text gives the end id alone; an empty table gives an empty folder and result; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_parts
from .encoders import encoder, text_lists

SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sBQQQQqQQ")
_EF = struct.Struct("<QBQQQ")
_SAMPLE = 64


class EliasFano:
    """Non-decreasing non-negative integers: low bits packed, high bits in unary, sampled select."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if int(v[-1]) >= n else 0
        lows = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1, np.uint8)
        flags[ones] = 1
        return cls(n, bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(flags, bitorder="little"), ones[::_SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        a, b = i * self.bits, (i + 1) * self.bits
        word = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return (word >> (a % 8)) & ((1 << self.bits) - 1)

    def __getitem__(self, i: int) -> int:
        """The i-th value: select of the i-th one from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, at = i % _SAMPLE, int(self.samples[i // _SAMPLE])
        step, base = 512, at - at % 8
        while True:
            flags = np.unpackbits(self.high[base // 8 : base // 8 + step // 8], bitorder="little")
            ones = np.flatnonzero(flags)
            ones = ones[ones + base >= at]
            if left < len(ones):
                return ((int(ones[left]) + base - i) << self.bits) | (self._low(i) if self.bits else 0)
            left, base = left - len(ones), base + step
            at = base

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        v = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            flags = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.uint64)
            v |= (flags << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return v

    def to_bytes(self) -> bytes:
        parts = self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()
        return _EF.pack(self.n, self.bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, *sizes = _EF.unpack_from(data, at)
        at, parts = at + _EF.size, []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, bits, *parts), at


def segment(doc_ids: list[int | None], ids: list[bytes], width: int, before: int) -> bytes:
    """Pack documents in ascending id order, nulls first."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    head = _HEAD.pack(b"RLT1", width, len(ids), int(ends[-1]), before, len(ids) - len(known), base, 0, 0)
    low = [d - base for d in known]
    return b"".join([head, EliasFano.encode(ends).to_bytes(), EliasFano.encode(low).to_bytes(), *ids])


class Segment:
    """Random access to a packed segment."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_ids, self.before, self.nulls, self.base, *_ = _HEAD.unpack_from(data)
        if magic != b"RLT1":
            raise ValueError("not a token segment")
        self.bounds, at = EliasFano.from_bytes(data, _HEAD.size)
        self.names, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.names[i - self.nulls]

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append ``end_id`` and write the segments into ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        end = np.asarray([end_id], enc.dtype).tobytes()
        names, held, size = [], [], 0

        def flush():
            nonlocal names, held, size, number, before
            data = segment(names, held, enc.width, before)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "number", "n_ids", "data"])
            names, held, number, before, size = [], [], number + 1, before + size, 0
            return row

        for rows, texts in text_lists(batches):
            for name, ids in zip(rows.column(0).to_pylist(), enc.encode(texts)):
                names.append(name)
                held.append(ids + end)
                size += len(held[-1]) // enc.width
                if size >= segment_ids:
                    yield flush()
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(shuffle_parts(docs), *order).sortWithinPartitions(order[0], "text")
    rows.mapInArrow(encode, "part int, number int, n_ids long, data binary").write.option("compression", "snappy").option("parquet.block.size", 16 << 20).parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files alone."""
    rows = spark.read.schema("part int, number int, n_ids long, data binary").parquet(path)
    sizes = sorted((p, n) for p, n in rows.groupBy("part").agg(F.sum("n_ids")).collect())  # one row for each partition
    starts, at = {}, 0
    for p, n in sizes:
        starts[p], at = at, at + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = Segment(data.as_buffer())
                bounds = s.bounds.decode().astype(np.int64)
                names = [None] * s.nulls + (s.names.decode().astype(np.int64) + s.base).tolist()
                raw = memoryview(s.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
                columns = [pa.array(names, pa.int64()), pa.array(bounds[:-1] + s.before + starts[p]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return rows.select("part", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

"""Long sequences cut into short overlapping parts, so that work on them is linear and spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS = 2048


def chunks(contigs: DataFrame, size: int, before: int = 0, after: int = 0, spread: bool = True) -> DataFrame:
    """(chrom, chunk, first, text): chunk c holds the bases from ``c * size`` on, with ``before`` bases ahead of
    them (``first`` is where ``text`` begins) and ``after`` behind. An empty sequence is one empty chunk.

    A sequence is walked once by the task that read it; ``spread`` deals its chunks over all tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chrom, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                starts = range(0, max(len(text), 1), size)
                for a in range(0, len(starts), _ROWS):
                    part = starts[a : a + _ROWS]
                    first = [max(s - before, 0) for s in part]
                    texts = [text[f : s + size + after] for f, s in zip(first, part)]
                    columns = [pa.array([chrom] * len(part), pa.string()), pa.array(range(a, a + len(part)), pa.int64()), pa.array(first, pa.int64()), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["chrom", "chunk", "first", "text"])

    rows = contigs.select(F.col("chrom").cast("string").alias("chrom"), "seq").mapInArrow(cut, "chrom string, chunk long, first long, text string")
    # a given number: what is made of chunks is many times their size, by which Spark would put them into one task
    parts = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "chrom", "chunk") if spread else rows

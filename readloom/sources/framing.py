"""Ordinals and record framing for line-oriented files.

Splits of a file are read in any order, so a line's number is its place in its split plus the lines of
the splits before it; only one count for each split is gathered. Records are framed inside the
splits; the few lines of records that cross a split's edge are put together by a small shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

_ID_BITS = 33


def with_ordinal(df: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """``df`` with ``ordinal``, counted in the order of the given columns.

    Rows are range partitioned and sorted, each partition is numbered on its own, and this is written
    once: sampled range bounds differ from run to run. Then partitions are shifted by the sizes of those
    before them, so no task sees all rows.
    """
    inside = F.monotonically_increasing_id().bitwiseAND((1 << _ID_BITS) - 1)
    rows = stored(df.orderBy(*order).withColumns({"part__": F.spark_partition_id(), "in__": inside}), "ordered")
    sizes = rows.groupBy("part__").agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("part__", F.coalesce(before, F.lit(0)).alias("base__"))
    return rows.join(F.broadcast(base), "part__").withColumn("ordinal", F.col("base__") + F.col("in__") + start).drop("part__", "in__", "base__")


def lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """(file, block, row, value): ``row`` rises inside a (file, block) but does not start at 0."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    text = reader.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def numbered(spark: SparkSession, path, line_sep: str | None = None, skip_empty: bool = True) -> DataFrame:
    """(file, line, value): every line with its number inside its file, from 0; empty lines are left out."""
    rows = lines(spark, path, line_sep)
    if skip_empty:
        rows = rows.where(F.length(F.rtrim(F.regexp_replace("value", "\r$", ""))) > 0)
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return _counted(rows, splits.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")))


def _counted(rows: DataFrame, base: DataFrame) -> DataFrame:
    joined = rows.join(F.broadcast(base), ["file", "block"]).select("file", "block", "base", "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for b in batches:
            # a split's lines follow one another: only where a split begins is looked at by itself
            block, base = (b.column(i).to_numpy() for i in (1, 2))
            file = pc.run_end_encode(b.column(0), run_end_type=pa.int32())
            cut = np.unique(np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (base[1:] != base[:-1])) + 1, np.asarray(file.run_ends)[:-1]])).astype(np.int64) if b.num_rows else []
            line = np.empty(b.num_rows, np.int64)
            for begin, end in zip(cut, [*cut[1:], b.num_rows]):
                key = (b.column(0)[int(begin)].as_py(), int(block[begin]))
                if key != now:
                    now, n = key, 0
                line[begin:end] = base[begin] + n + np.arange(end - begin)
                n += int(end - begin)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(line), b.column(3)], ["file", "line", "value"])

    return joined.mapInArrow(count, "file string, line long, value string")


def framed(numbered_lines: DataFrame, size: int) -> DataFrame:
    """(file, record, lines): ``size`` consecutive lines a record; a last, incomplete one stays incomplete."""
    rows = numbered_lines.select("file", "line", "value")

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # lines of a record that the next batch may go on with
        for b in batches:
            if held is not None and held.num_rows:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = None
            if not b.num_rows:
                continue
            line = b.column(1).to_numpy()
            file = pc.run_end_encode(b.column(0), run_end_type=pa.int32())
            new = (line // size)[1:] != (line // size)[:-1]
            new |= line[1:] != line[:-1] + 1
            new[np.asarray(file.run_ends)[:-1] - 1] = True
            cut = np.concatenate([[0], np.flatnonzero(new) + 1]).astype(np.int64)
            if line[-1] % size != size - 1:
                held = b.slice(int(cut[-1]))
                end, cut = int(cut[-1]), cut[:-1]
            else:
                end = b.num_rows
            yield _frames(b, line, cut, end)
        if held is not None and held.num_rows:
            yield _frames(held, held.column(1).to_numpy(), np.zeros(1, np.int64), held.num_rows)

    def _frames(b, line, cut, end):
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, end).astype(np.int32)), b.column(2).slice(0, end))
        first = pa.array(cut)
        return pa.RecordBatch.from_arrays([b.column(0).take(first), pa.array(line[cut] // size), pa.array((line[cut] % size).astype(np.int32)), lists], ["file", "record", "at", "lines"])

    parts = rows.mapInArrow(frame, "file string, record long, at int, lines array<string>")
    whole = parts.where(F.size("lines") == size).select("file", "record", "lines")
    torn = parts.where(F.size("lines") < size).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "lines"))).alias("p"))
    return whole.unionByName(torn.select("file", "record", F.flatten("p.lines").alias("lines")))


def global_ordinal(records: DataFrame, count_key: str = "record") -> DataFrame:
    """``records`` with ``ordinal`` over all files in path order; needs file and record."""
    sizes = records.groupBy("file").agg(F.max(count_key).alias("m"))
    before = F.sum(F.col("m") + 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("file", F.coalesce(before, F.lit(0)).alias("base__"))
    return records.join(F.broadcast(base), "file").withColumn("ordinal", F.col("base__") + F.col(count_key)).drop("base__")

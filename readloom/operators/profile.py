"""Statistics over reads and alignments: quality, error and indel profiles, GC against depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .chunks import chunks


#: Distinct cells that a task holds before it passes its counts on.
_CELLS = 1 << 20


def cells(rows: DataFrame, codes, names: list[str], shapes: list[int]) -> DataFrame:
    """(names..., n): how often each cell occurs, cells being whole numbers under ``shapes``.

    ``codes`` maps an Arrow batch to arrays of cell numbers, one for each name. They are counted inside the task, so
    what is shuffled are tables of counts, not bases.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(key, n):
            key, at = np.unique(key, return_inverse=True)
            return key, np.bincount(at, n, len(key)).astype(np.int64)

        def out(key, n):
            columns = []
            for size in reversed(shapes):
                columns.append(pa.array(key % size, pa.int32()))
                key = key // size
            return pa.RecordBatch.from_arrays([*reversed(columns), pa.array(n)], [*names, "n"])

        held, size = [], 0
        for b in batches:
            key = np.zeros(1, np.int64)
            for c, most in zip(codes(b), shapes):
                key = key * most + c
            held.append(table(key, None) if len(key) else (key, np.zeros(0, np.int64)))
            size += len(held[-1][0])
            if size > _CELLS:
                held = [table(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > _CELLS:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*table(*(np.concatenate(x) for x in zip(*held))))

    made = rows.mapInArrow(count, ", ".join(f"{n} int" for n in names) + ", n long")
    return made.groupBy(*names).agg(F.sum("n").alias("n"))


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, the row of each, and its place in it; null counts as empty."""
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text) or text.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    size = np.diff(at)
    row = np.repeat(np.arange(len(text)), size)
    return np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]], row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)


#: Cells of a cycle and of a quality (shifted, for encodings that go below 0).
_CYCLE, _Q, _SHIFT = 1 << 20, 512, 128


def _qualities(reads: DataFrame, base: int) -> DataFrame:
    """(cycle, q, n) of all bases, cycles from 1."""

    def codes(b: pa.RecordBatch):
        value, _, place = _bytes(b.column(0))
        return place + 1, value.astype(np.int64) - base + _SHIFT

    made = cells(reads.select("qual"), codes, ["cycle", "q"], [_CYCLE, _Q])
    return made.select("cycle", (F.col("q") - _SHIFT).alias("q"), "n")


def quality_by_cycle(reads: DataFrame, cut: str | None = None, base: int = 33) -> DataFrame:
    """(cycle, n, mean_q); with ``cut`` trailing characters of that kind are left out."""
    if cut:
        reads = reads.withColumn("qual", F.regexp_replace("qual", f"\\Q{cut}\\E+$", ""))
    table = _qualities(reads, base)
    return table.groupBy("cycle").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("q")).alias("s")).select("cycle", F.col("total").alias("n"), (F.col("s") / F.col("total")).alias("mean_q"))


def read_quality_bins(reads: DataFrame, width: float = 0.5, base: int = 33) -> DataFrame:
    """(bin, n) of the mean quality of reads."""
    mean = S.mean_quality("qual", base)
    return reads.select((F.floor(mean / width) * width).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def transitions(reads: DataFrame, base: int = 33) -> DataFrame:
    """(cycle, prev_q, q, n) of neighbouring qualities."""

    def codes(b: pa.RecordBatch):
        value, row, place = _bytes(b.column(0))
        value = value.astype(np.int64) - base + _SHIFT
        k = np.flatnonzero(row[1:] == row[:-1]) + 1 if len(row) else np.zeros(0, np.int64)
        return place[k] + 1, value[k - 1], value[k]

    made = cells(reads.select("qual"), codes, ["cycle", "prev_q", "q"], [_CYCLE, _Q, _Q])
    return made.select("cycle", (F.col("prev_q") - _SHIFT).alias("prev_q"), (F.col("q") - _SHIFT).alias("q"), "n")


def transition_moments(table: DataFrame) -> DataFrame:
    """(prev_q, n, mean, sd, low, high, mode) of the next quality, from ``transitions``."""
    by = table.groupBy("prev_q", "q").agg(F.sum("n").alias("n"))
    n, q = F.col("n").cast("double"), F.col("q").cast("double")
    out = by.groupBy("prev_q").agg(
        F.sum("n").alias("n"), (F.sum(n * q) / F.sum(n)).alias("mean"), (F.sum(n * q * q) / F.sum(n)).alias("m2"), F.min("q").alias("low"), F.max("q").alias("high"),
        F.max(F.struct(F.col("n"), (-F.col("q")).alias("q"))).alias("m"),
    )
    sd = F.sqrt(F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return out.select("prev_q", "n", "mean", sd.alias("sd"), "low", "high", (-F.col("m.q")).alias("mode"))


def base_calls(aligned: DataFrame, base: int = 33) -> DataFrame:
    """(ref, cycle, call, q, n) from (ref_seq, seq, qual) of equal length; ref in ACGT, call not N. Other rows are left out."""

    def codes(b: pa.RecordBatch):
        (ref, _, place), (call, _, _), (q, _, _) = (_bytes(b.column(i)) for i in range(3))
        k = np.flatnonzero(np.isin(ref, np.frombuffer(b"ACGT", np.uint8)) & (call != ord("N")))
        return ref[k], place[k] + 1, call[k], q[k].astype(np.int64) - base + _SHIFT

    size = F.octet_length("ref_seq")
    rows = aligned.select("ref_seq", "seq", "qual").where((size == F.octet_length("seq")) & (size == F.octet_length("qual")))
    made = cells(rows, codes, ["ref", "cycle", "call", "q"], [128, _CYCLE, 128, _Q])
    return made.select(F.char("ref").alias("ref"), "cycle", F.char("call").alias("call"), (F.col("q") - _SHIFT).alias("q"), "n")


def merge_counts(*tables: DataFrame, value: str = "n") -> DataFrame:
    """Cell-wise sum of count tables of one shape."""
    keys = [c for c in tables[0].columns if c != value]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def mismatch_rates(calls: DataFrame, *by: str) -> DataFrame:
    """(by..., n, mismatch_rate, expected_rate): observed against what qualities promise."""
    wrong = F.when(F.col("ref") != F.col("call"), F.col("n")).otherwise(0)
    return calls.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(wrong) / F.sum("n")).alias("mismatch_rate"), (F.sum(S.error_rate("q") * F.col("n")) / F.sum("n")).alias("expected_rate"))


def base_changes(calls: DataFrame) -> DataFrame:
    """(ref, call, rate): share of each call among the calls of a reference base."""
    by = calls.groupBy("ref", "call").agg(F.sum("n").alias("n"))
    total = by.groupBy("ref").agg(F.sum("n").alias("t"))
    return by.join(total, "ref").select("ref", "call", (F.col("n") / F.col("t")).alias("rate"))


def indels(aligned: DataFrame) -> DataFrame:
    """(cycle, indel_len, n): insertions positive, deletions negative, at the read cycle before them."""
    ops = S.cigar_ops("cigar")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<cycle:int,len:int>>").alias("out"))

    def step(s, x):
        moves = F.when(x["op"].isin("M", "I", "S", "=", "X"), x["len"]).otherwise(0)
        size = F.when(x["op"] == "I", x["len"]).otherwise(-x["len"])
        found = F.when(x["op"].isin("I", "D"), F.array(F.struct(s["at"].alias("cycle"), size.alias("len")))).otherwise(F.array().cast("array<struct<cycle:int,len:int>>"))
        return F.struct((s["at"] + moves).alias("at"), F.concat(s["out"], found).alias("out"))

    rows = aligned.select(F.explode(F.aggregate(ops, zero, step, lambda s: s["out"])).alias("x"))
    return rows.groupBy(F.col("x.cycle").alias("cycle"), F.col("x.len").alias("indel_len")).agg(F.count("*").alias("n"))


def insert_sizes(aligned: DataFrame, tlen: str = "tlen") -> DataFrame:
    """(size, n) of proper pairs, each counted once."""
    rows = aligned.where(S.flag("flag", "proper_pair") & (F.col(tlen) > 0))
    return rows.groupBy(F.col(tlen).alias("size")).agg(F.count("*").alias("n"))


def weighted_moments(hist: DataFrame, value: str = "size", n: str = "n") -> DataFrame:
    """(total, mean, sd) of a histogram."""
    v, w = F.col(value).cast("double"), F.col(n).cast("double")
    out = hist.agg(F.sum(n).alias("total"), (F.sum(v * w) / F.sum(w)).alias("mean"), (F.sum(v * v * w) / F.sum(w)).alias("m2"))
    return out.select("total", "mean", F.sqrt(F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))


def insert_distribution(sizes: DataFrame, first: int = 10_000, order: str = "ordinal") -> DataFrame:
    """Mean and sd of the first ``first`` insert sizes."""
    return sizes.orderBy(order).limit(first).agg(F.avg("size").alias("mean"), F.stddev("size").alias("sd"))


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """One row: all, mapped, unmapped, proper pairs, duplicates, reverse."""
    names = {"unmapped": "unmapped", "proper": "proper_pair", "duplicate": "duplicate", "reverse": "reverse"}
    return aligned.agg(F.count("*").alias("n"), F.count_if(~S.flag("flag", "unmapped")).alias("mapped"), *[F.count_if(S.flag("flag", v)).alias(k) for k, v in names.items()])


def gc_depth(windows: DataFrame, least_known: int = 30, most_n: float = 0.75) -> DataFrame:
    """GC bins of (seq, depth) windows: count, mean, quartiles, whiskers within 1.5 IQR, min and max.

    Quartiles follow ranks: of an odd count values stand for them, of an even one the first two lie between two
    values and the third is one. Bins of fewer than 3 (odd) or 4 (even) windows have quartiles of 0.

    Windows with N of 75 % or more, or with 30 or fewer known bases, are left out; the bin of a window
    is the integer part of its GC percent, named by its middle.
    """
    size, n = F.length("seq"), S.count_chars("seq", "Nn")
    rows = windows.where((n < most_n * size) & (size - n > least_known))
    rows = rows.select((F.floor(S.gc_percent("seq")) + 0.5).alias("gc"), F.col("depth").cast("double").alias("d"))
    w, n = Window.partitionBy("gc"), F.col("n")
    ranked = rows.withColumns({"k": F.row_number().over(w.orderBy("d")), "n": F.count("*").over(w)})
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("d")))
    # ranks from 1, of values in order; an even count lies between two of them for the first two quartiles
    quarter, half = F.floor((n + 1) / 4), F.floor((n + 1) / 2)
    third = quarter * 3
    out = ranked.groupBy("gc", "n").agg(
        F.avg("d").alias("mean"), F.min("d").alias("low"), F.max("d").alias("high"), at(quarter).alias("a1"), at(quarter + 1).alias("b1"), at(half).alias("a2"),
        at(half + 1).alias("b2"), at(third).alias("a3"),
    )
    between = lambda a, b, k: F.when(n % 2 == 0, F.col(a) + (F.col(b) - F.col(a)) * (k - F.floor(k))).otherwise(F.col(a))
    few = n < F.when(n % 2 == 0, 4).otherwise(3)
    zero = F.lit(0.0)
    out = out.select("gc", "n", "mean", "low", "high", F.when(few, zero).otherwise(between("a1", "b1", (n + 1) / 4)).alias("q1"), F.when(few, zero).otherwise(between("a2", "b2", (n + 1) / 2)).alias("q2"), F.when(few, zero).otherwise(F.col("a3")).alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    # the whiskers end at values: the first above the lower fence, the last not above the upper one
    ends = rows.join(out.select("gc", (F.col("q1") - fence).alias("f0"), (F.col("q3") + fence).alias("f1")), "gc").groupBy("gc").agg(
        F.min(F.when(F.col("d") > F.col("f0"), F.col("d"))).alias("w0"), F.max(F.when(F.col("d") <= F.col("f1"), F.col("d"))).alias("w1"),
    )
    out = out.join(ends, "gc")
    return out.select("gc", "n", "mean", "q1", "q2", "q3", F.coalesce("w0", "high").alias("whisker_low"), F.coalesce("w1", "low").alias("whisker_high"), "low", "high")


def tiles(contigs: DataFrame, width: int) -> DataFrame:
    """(chrom, tile, seq): windows of ``width`` bases."""
    return chunks(contigs.where(F.length("seq") > 0), width).select("chrom", F.col("chunk").cast("int").alias("tile"), F.col("text").alias("seq"))


def tile_quality(reads: DataFrame, pattern: str = r"^[^:]*:\d+:(\d+):", prefixes: tuple[int, ...] = (1, 5, 10, 15, 30, 50)) -> DataFrame:
    """(tile, prefix, mean_q) of the first bases of reads, by the tile in their name; prefix 0 is all."""
    rows = reads.withColumn("tile", F.regexp_extract("name", pattern, 1))
    heads = F.array(*[F.struct(F.lit(p).alias("prefix"), F.expr(f"substring(qual, 1, {p})").alias("h")) for p in prefixes], F.struct(F.lit(0).alias("prefix"), F.col("qual").alias("h")))
    rows = rows.select("tile", F.explode(heads).alias("x")).where(F.length("x.h") > 0)
    return rows.groupBy("tile", F.col("x.prefix").alias("prefix")).agg((F.sum(S.quality_sum("x.h")) / F.sum(F.length("x.h"))).alias("mean_q"))


def loess(table: DataFrame, x: str, y: str, span: int) -> DataFrame:
    """``table`` with ``smoothed``: a locally weighted line over ``span`` neighbours each side, not below 0.

    Tricube weights by distance. Neighbours are gathered by equi-joins on the rank, so nothing but the
    ranking of the (small) table needs one order.
    """
    rows = table.withColumn("r__", F.row_number().over(Window.orderBy(x)))
    near = rows.select(F.col("r__").alias("o__"), F.col(x).cast("double").alias("nx"), F.col(y).cast("double").alias("ny"))
    pairs = rows.select("r__", F.col(x).cast("double").alias("x0"), F.explode(F.sequence(F.col("r__") - span, F.col("r__") + span)).alias("o__")).join(near, "o__")
    far = pairs.groupBy("r__").agg(F.max(F.abs(F.col("nx") - F.col("x0"))).alias("far"))
    pairs = pairs.join(far, "r__")
    w = F.when(F.col("far") > 0, F.pow(1 - F.pow(F.abs(F.col("nx") - F.col("x0")) / (F.col("far") * 1.0001), 3), 3)).otherwise(1.0)
    d = F.col("nx") - F.col("x0")
    s = pairs.groupBy("r__").agg(F.sum(w).alias("s0"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"), F.sum(w * F.col("ny")).alias("t0"), F.sum(w * d * F.col("ny")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(F.abs(det) > 1e-12, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.col("t0") / F.col("s0"))
    return rows.join(s.select("r__", F.greatest(fit, F.lit(0.0)).alias("smoothed")), "r__").drop("r__")


def best_kmer(table: DataFrame, kmer: str = "kmer", count: str = "cnt") -> DataFrame:
    """The k-mer with the largest count; the smallest of ties."""
    return table.orderBy(F.desc(count), kmer).limit(1).select(kmer, count)


def drop_short(rows: DataFrame, least: int, *seqs: str) -> DataFrame:
    """Rows (or pairs) all of whose sequences have ``least`` bases."""
    keep: Column = F.lit(True)
    for c in seqs:
        keep = keep & (F.length(c) >= least)
    return rows.where(keep)

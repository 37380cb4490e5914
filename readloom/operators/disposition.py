"""What becomes of a read: tags, output text, summaries and demultiplexing. Narrow projections all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

TAGS = ("NORMAL", "BLURRY", "BADQUAL", "EMPTY", "SHORT", "CONTAMINANT", "UNDETERMINED", "LONG")


def dispose(
    reads: DataFrame, adapter_pos: Column | str | None = None, min_len: int = 18, max_len: int | None = None, cut_long: bool = False,
    epsilon: float = 0.1, drop_blurry: bool = False, mean_quality: int = 0, end_quality: int = 0, base: int = 33,
) -> DataFrame:
    """``reads`` with ``tag`` and ``pos``, the length left.

    In this order: blurry, bad mean quality, adapter position (default: none found), no less than 0,
    3' quality trim, then EMPTY (nothing left), SHORT, LONG (or cut to ``max_len``).
    """
    size = F.length("seq")
    found = size if adapter_pos is None else S.col(adapter_pos)
    left = F.greatest(F.lit(0), F.least(found, size))
    if end_quality > 0:
        left = S.quality_trim3(F.substring(F.col("qual"), F.lit(1), left), end_quality, base)
    tag = F.when(S.is_blurry("seq", epsilon), "BLURRY") if drop_blurry else F.when(F.lit(False), "")
    if mean_quality > 0:
        tag = tag.when(~S.quality_passes("qual", mean_quality, base), "BADQUAL")
    pos = F.col("pos")
    tag = tag.when((pos < min_len) & (pos <= 0), "EMPTY").when(pos < min_len, "SHORT")
    if max_len is not None and not cut_long:
        tag = tag.when(pos > max_len, "LONG")
    out = reads.withColumn("pos", left.cast("int")).withColumn("tag", tag.otherwise("NORMAL"))
    return out.withColumn("pos", F.least("pos", F.lit(max_len))) if cut_long and max_len is not None else out


def trimmed(disposed: DataFrame, keep: str = "head", fill_n: bool = False) -> DataFrame:
    """NORMAL reads with ``seq`` and ``qual`` cut to ``pos`` (``keep="tail"``: the last ``pos`` bases)."""
    rows = disposed.where(F.col("tag") == "NORMAL")
    if fill_n:
        return rows.withColumns({"seq": S.n_filled("seq", "pos"), "qual": S.quality_filled("qual", "pos")})
    if keep == "tail":
        cut = lambda c: F.substring(F.col(c), F.length(c) - F.col("pos") + 1, F.col("pos"))
    else:
        cut = lambda c: F.substring(F.col(c), F.lit(1), F.col("pos"))
    return rows.withColumns({"seq": cut("seq"), "qual": cut("qual")})


def masked_reads(disposed: DataFrame) -> DataFrame:
    """NORMAL reads that were shortened, whole, with the trimmed part in lower case."""
    return disposed.where((F.col("tag") == "NORMAL") & (F.col("pos") < F.length("seq"))).withColumn("seq", S.masked("seq", "pos"))


def excluded(disposed: DataFrame) -> DataFrame:
    """Reads that were not kept, with their tag in the name."""
    return disposed.where(F.col("tag") != "NORMAL").withColumn("name", F.concat_ws(" ", "name", "tag"))


def summary(disposed: DataFrame) -> DataFrame:
    """(tag, n, percent); the total comes from a one-row aggregate."""
    counts = disposed.groupBy("tag").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("tag", "n", (100.0 * F.col("n") / F.col("t")).alias("percent"))


def length_histogram(rows: DataFrame, length: Column | str = "pos") -> DataFrame:
    return rows.groupBy(S.col(length).alias("len")).agg(F.count("*").alias("n"))


def pair_length(pos1: str = "pos1", pos2: str = "pos2") -> Column:
    """Length that a pair counts with in the histogram: the integer mean of both mates."""
    return F.floor((F.col(pos1) + F.col(pos2)) / 2).cast("int")


def trimmed_percent(disposed: DataFrame) -> DataFrame:
    """One row: reads, trimmed reads (shortened or not kept) and their percent."""
    cut = (F.col("tag") != "NORMAL") | (F.col("pos") < F.length("seq"))
    out = disposed.agg(F.count("*").alias("n"), F.count_if(cut).alias("n_trimmed"))
    return out.withColumn("percent", 100.0 * F.col("n_trimmed") / F.col("n"))


def best_seed(runs: DataFrame) -> DataFrame:
    """Of (seed_len, percent) rows the one with the highest percent; ties to the longest seed."""
    return runs.agg(F.max(F.struct("percent", "seed_len")).alias("m")).select("m.seed_len", "m.percent")


def barcode(reads: DataFrame, barcodes: list[tuple[str, str]], seq: str = "seq") -> DataFrame:
    """``reads`` with ``barcode``: the name whose sequence the read starts with, else ``unassigned``."""
    c = F.when(F.lit(False), "")
    for name, text in barcodes:
        c = c.when(F.col(seq).startswith(text), name)
    return reads.withColumn("barcode", c.otherwise("unassigned"))


def collapse(reads: DataFrame, *keys: str) -> DataFrame:
    """(seq, [keys...], n): identical sequences counted, combined before the shuffle."""
    return reads.groupBy("seq", *keys).agg(F.count("*").alias("n"))

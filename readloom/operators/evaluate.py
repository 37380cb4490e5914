"""Scoring of trimmed reads against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(out: DataFrame, truth: DataFrame, read_length: int) -> DataFrame:
    """(name, out_len, truth_len, outcome). Both sides have (name, len); every truth row is kept.

    Equal lengths: TN if whole, else TP. Longer than truth: FN. Shorter: FP. Missing from the
    output: TP where nothing was to be left, else FP.
    """
    a, b = F.col("out_len"), F.col("truth_len")
    rows = truth.select("name", F.col("len").alias("truth_len")).join(out.select("name", F.col("len").alias("out_len")), "name", "left")
    missing = F.when(b == 0, "TP").otherwise("FP")
    found = F.when((a == b) & (a == read_length), "TN").when(a == b, "TP").when(a > b, "FN").otherwise("FP")
    return rows.withColumn("outcome", F.when(a.isNull(), missing).otherwise(found))


def paired_lengths(pairs: DataFrame, r1: str = "r1", r2: str = "r2") -> DataFrame:
    """(name, len) of pairs: the shorter mate; a single N counts as nothing."""
    size = lambda c: F.when(F.col(c) == "N", 0).otherwise(F.length(c))
    return pairs.select("name", F.least(size(r1), size(r2)).alias("len"))


def confusion(scored: DataFrame) -> DataFrame:
    """One row: tp, tn, fp, fn."""
    return scored.agg(*[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "TN", "FP", "FN")])


def metrics(counts: DataFrame) -> DataFrame:
    """acc, sen, spc, ppv and mcc; a zero cell counts as one."""
    c = counts.select(*[F.when(F.col(k) == 0, 1).otherwise(F.col(k)).cast("double").alias(k) for k in ("tp", "tn", "fp", "fn")])
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return c.select(
        ((tp + tn) / (tp + tn + fp + fn)).alias("acc"), (tp / (tp + fn)).alias("sen"), (tn / (tn + fp)).alias("spc"),
        (tp / (tp + fp)).alias("ppv"), ((tp * tn - fp * fn) / root).alias("mcc"),
    )


def trim_errors(scored: DataFrame) -> DataFrame:
    """Bases left that should have gone, and bases gone that should have stayed."""
    d = F.coalesce("out_len", F.lit(0)) - F.col("truth_len")
    return scored.agg(F.sum(F.greatest(d, F.lit(0))).alias("under_trimmed"), F.sum(F.greatest(-d, F.lit(0))).alias("over_trimmed"))

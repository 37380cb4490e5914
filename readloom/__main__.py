"""Command line: ``python -m readloom {build,single,paired,smallrna,known} ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import disposition, kmers, overlap, seeds
from .plans import modes
from .session import ship
from .sources import reads as io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom")
    sub = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, output: str | None = None) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        if output:
            s.add_argument("-1", "--input1", required=True)
            s.add_argument("-o", "--output", default=output)
            s.add_argument("-m", "--min_length", type=int, default=0)
            s.add_argument("--gzip", action="store_true", help="compress the output")
        return s

    def detection(s, prune: float) -> None:
        s.add_argument("-f", "--prune_factor", type=float, default=prune)
        s.add_argument("--sensitive", action="store_true")

    def seeds_of(s) -> None:
        s.add_argument("-M", "--max_align", type=int, default=0, help="0: no limit")
        s.add_argument("-e", "--no_mismatch", action="store_true")
        s.add_argument("-a", "--adapter", default=modes.ADAPTER1, help="used if none is found")
        s.add_argument("-u", "--UMI", action="store_true", help="print the estimated UMI size")

    def quality(s) -> None:
        s.add_argument("--max_length", type=int)
        s.add_argument("-q", "--end_quality", type=int, default=0)
        s.add_argument("-Q", "--mean_quality", type=int, default=0)

    s = mode("build")
    s.add_argument("-r", "--ref_path", required=True)
    s.add_argument("-p", "--index_prefix", required=True)
    s.add_argument("-d", "--seed_len", type=int, default=50, help="k of the seed table")
    s = mode("single", "trimmed_se")
    s.add_argument("-p", "--index_prefix", required=True)
    s.add_argument("-d", "--seed_len", type=int, default=50)
    for add in (seeds_of, quality):
        add(s)
    detection(s, 0.03)
    s = mode("paired", "trimmed_pe")
    s.add_argument("-2", "--input2", required=True)
    s.add_argument("-a", "--adapter1", default=modes.ADAPTER1)
    s.add_argument("-A", "--adapter2", default=modes.ADAPTER2)
    for letter, name, rate in (("-M", "--rc_thres", 0.7), ("-s", "--ss_thres", 0.9), ("-S", "--as_thres", 0.8)):
        s.add_argument(letter, name, type=float, default=rate)
    detection(s, 0.03)
    s = mode("smallrna", "trimmed_sr")
    s.add_argument("-r", "--ref_path", required=True, help="seed tables are made from it for each length")
    s.add_argument("-s", "--min_seed_len", type=int, default=18)
    s.add_argument("-d", "--max_seed_len", type=int, default=20)
    for add in (seeds_of, quality):
        add(s)
    detection(s, 0.1)
    s = mode("known", "trimmed")
    s.add_argument("-a", "--adapter", default=modes.ADAPTER1)
    quality(s)
    return p


def _rate(value: float, default: int) -> int:
    """A rate as percent; outside (0, 1) the default."""
    return round(100 * value) if 0 < value < 1 else default


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = ship(spark or SparkSession.builder.appName("readloom").getOrCreate())
    if a.mode == "build":
        modes.build(io.read_contigs(spark, a.ref_path), a.seed_len, a.index_prefix)
        return
    if a.mode == "paired":
        pairs = io.pair_up(modes.load(spark, a.input1), modes.load(spark, a.input2)).withColumn("pair_id", F.col("ordinal"))
        rates = {"match": _rate(a.rc_thres, 70), "seq": _rate(a.ss_thres, 90)}
        adapters = modes.detect_paired(pairs, a.prune_factor, a.sensitive, "pair_id", (a.adapter1, a.adapter2), **rates)
        out = overlap.trim_pairs(pairs, adapters, a.min_length, adapter=_rate(a.as_thres, 80), **rates)
        print("adapters:", *adapters)
        for i in (1, 2):
            mate = out.select("ordinal", F.col(f"n{i}").alias("name"), F.col(f"r{i}").alias("seq"), F.col(f"q{i}").alias("qual"))
            io.write_reads(mate, f"{a.output}_{i}", gzip=a.gzip)
        return
    reads = modes.load(spark, a.input1)
    options = {"min_len": a.min_length, "max_len": a.max_length, "end_quality": a.end_quality, "mean_quality": a.mean_quality}
    if a.mode == "known":
        done = modes.trim_known(reads, a.adapter, **options)
    elif a.mode == "single":
        index = seeds.load_index(spark, a.index_prefix, a.seed_len)
        done = modes.single(reads, index, a.adapter, a.prune_factor, a.sensitive, a.max_align, not a.no_mismatch, **options)
    else:
        done, _ = modes.small_rna(reads, io.read_contigs(spark, a.ref_path), range(a.min_seed_len, a.max_seed_len + 1), a.adapter, a.prune_factor, sensitive=a.sensitive, max_align=a.max_align, allow_mismatch=not a.no_mismatch, **options)
    print("adapter:", done.adapter)
    if getattr(a, "UMI", False):
        cut = done.reads.where(F.col("pos") < F.length("seq")).select(F.expr("substring(seq, pos + 1)").alias("tail"))
        print("UMI size:", kmers.umi_size(cut, done.adapter))
    disposition.summary(done.reads).show()
    io.write_reads(disposition.trimmed(done.reads), a.output, gzip=a.gzip)


if __name__ == "__main__":
    main()

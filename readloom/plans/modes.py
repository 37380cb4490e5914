"""The composite modes: build an index, and trim single reads, pairs, small RNA, or with a known adapter."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapter, disposition, kmers, overlap, seeds
from ..storage import stored
from .views import ADAPTER1, ADAPTER2

SAMPLE, BATCHES = 10_000, 3


@dataclass
class Trimmed:
    """Disposed reads (tag, pos), and the adapter they were trimmed with."""

    reads: DataFrame
    adapter: str
    low_complexity: bool = False


def build(contigs: DataFrame, k: int, path: str | None = None) -> seeds.SeedIndex:
    index = seeds.build_index(contigs, k)
    if path is None:
        return index
    seeds.save_index(index, path)
    return seeds.load_index(contigs.sparkSession, path, k)


def first_reads(reads: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The largest sample of ``detect_single``, written once."""
    return stored(seeds.sample(reads.select("read_id", "seq"), SAMPLE * batches), "sample")


def detect_single(reads: DataFrame, index: seeds.SeedIndex, prune_factor: float = 0.03, sensitive: bool = False, max_align: int = 0, allow_mismatch: bool = True, least_tails: int = 3000, batches: int = BATCHES, sampled: DataFrame | None = None) -> tuple[str, bool]:
    """Adapter of single reads from the tails that do not align: up to three samples until 3,000 tails.

    ``sampled`` has the largest sample's ``read_id`` and ``seq``, if several seed lengths share it.
    """
    sampled = first_reads(reads, batches) if sampled is None else sampled
    n, found = SAMPLE, None
    for i in range(batches):
        part = seeds.sample(sampled, n * (i + 1))
        rows = seeds.seed_align(part, index, max_align, allow_mismatch).where(F.length("tail") > 0)
        found = stored(seeds.merged(rows).select("tail"), "tails")  # counted here, then gone through for each k
        if i == batches - 1 or found.count() >= least_tails:
            break
    text, low = kmers.assemble(found, prune_factor, sensitive)
    return text[: 16 if low else 32], low


def trim_known(reads: DataFrame, text: str, epsilon: float = 0.2, low_complexity: bool = False, **options) -> Trimmed:
    """Trim with a given adapter."""
    if not text:
        return Trimmed(disposition.dispose(reads, None, **options), "")
    found = reads.withColumn("a__", adapter.adapter_pos("seq", "qual", [text], epsilon=epsilon))
    return Trimmed(disposition.dispose(found, F.col("a__.pos"), **options).drop("a__"), text, low_complexity)


def single(reads: DataFrame, index: seeds.SeedIndex, default: str = ADAPTER1, prune_factor: float = 0.03, sensitive: bool = False, max_align: int = 0, allow_mismatch: bool = True, sampled: DataFrame | None = None, **options) -> Trimmed:
    """Detect the adapter of single reads, then trim; the default adapter if none is found."""
    text, low = detect_single(reads, index, prune_factor, sensitive, max_align, allow_mismatch, sampled=sampled)
    return trim_known(reads, text or default, low_complexity=low, **options)


def detect_paired(pairs: DataFrame, prune_factor: float = 0.03, sensitive: bool = False, order: str = "pair_id", defaults: tuple[str, str] = (ADAPTER1, ADAPTER2), **rates) -> tuple[str, str]:
    """Adapters of both mates from a sample of pairs that read through their insert."""
    part = overlap.tails(pairs.orderBy(order).limit(SAMPLE), **rates)
    found = [kmers.assemble(part.select(F.col(c).alias("tail")), prune_factor, sensitive) for c in ("tail1", "tail2")]
    if not all(text for text, _ in found):
        return defaults
    size = min(len(found[0][0]), len(found[1][0]), 32)
    if any(low for _, low in found):
        size = min(size, 15)
    return found[0][0][:size], found[1][0][:size]


def paired(pairs: DataFrame, min_length: int = 0, adapters: tuple[str, str] | None = None, **options) -> tuple[DataFrame, tuple[str, str]]:
    """Detect both adapters (unless given) and trim pairs to their insert."""
    adapters = adapters or detect_paired(pairs, **options)
    return overlap.trim_pairs(pairs, adapters, min_length), adapters


def small_rna(reads: DataFrame, contigs: DataFrame, seed_lengths=range(18, 21), default: str = ADAPTER1, prune_factor: float = 0.1, **options) -> tuple[Trimmed, DataFrame]:
    """Try seed lengths and keep the one that trims most reads; ties go to the longest.

    All share one sample of reads. Trimming depends on the adapter only: seed lengths that find the same one trim
    the same reads, and all reads are gone through to compare adapters, not seed lengths.
    """
    sampled = first_reads(reads)
    runs = {k: single(reads, build(contigs, k), default, prune_factor, sampled=sampled, **options) for k in seed_lengths}
    lengths: dict[str, list[int]] = {}
    for k, run in runs.items():
        lengths.setdefault(run.adapter, []).append(k)
    percents = [disposition.trimmed_percent(runs[ks[0]].reads) for ks in lengths.values()]
    if len(lengths) > 1:
        percents = [reads.sparkSession.createDataFrame([(x.first()["percent"],)], "percent double") for x in percents]
    each = [x.select(F.explode(F.array(*map(F.lit, ks))).alias("seed_len"), "percent") for x, ks in zip(percents, lengths.values())]
    best = disposition.best_seed(functools.reduce(DataFrame.unionByName, each))
    return runs[best.first()["seed_len"] if len(lengths) > 1 else max(runs)], best


def paired_separate(pairs: DataFrame, adapters1: list[str], adapters2: list[str], min_len: int = 18, **options) -> DataFrame:
    """Mates trimmed on their own; a pair is NORMAL if both mates keep ``min_len`` bases."""
    rows = adapter.trim_mates(pairs, adapters1, adapters2, **options)
    rows = rows.withColumns({"pos1": F.col("a1.pos"), "pos2": F.col("a2.pos")})
    both, one = (F.col("pos1") < min_len) & (F.col("pos2") < min_len), (F.col("pos1") < min_len) | (F.col("pos2") < min_len)
    tag = F.when(both & (F.greatest("pos1", "pos2") <= 0), "EMPTY").when(one, "SHORT").otherwise("NORMAL")
    return rows.withColumn("tag", tag).drop("a1", "a2")


def paired_joint(pairs: DataFrame, adapters1: list[str], adapters2: list[str], min_len: int = 18, mean_quality: int = 0, **options) -> DataFrame:
    """Mates trimmed together at one place; dropped for quality only if both mates fail."""
    from ..functions import sequence as S

    rows = pairs.withColumn("p", adapter.pair_pos(adapters1, adapters2, **options)).select("*", F.col("p.pos").alias("pos"), F.col("p.idx1").alias("idx1"), F.col("p.idx2").alias("idx2")).drop("p")
    tag = F.when(F.lit(False), "")
    if mean_quality:
        tag = tag.when(~S.quality_passes("q1", mean_quality) & ~S.quality_passes("q2", mean_quality), "BADQUAL")
    return rows.withColumn("tag", tag.when(F.col("pos") <= 0, "EMPTY").when(F.col("pos") < min_len, "SHORT").otherwise("NORMAL"))


def amplicon(reads: DataFrame, forward: list[str], reverse: list[str], exchange: bool = True, min_len: int = 18, **options) -> DataFrame:
    """Reads cut between primers; reads found in the other orientation are turned round if ``exchange``.

    UNDETERMINED: not both primers were found.
    """
    from ..functions import sequence as S

    rows = reads.withColumn("b", adapter.amplicon_bounds(forward, reverse, **options))
    cut = {c: F.expr(f"substring({c}, b.begin + 1, b.end - b.begin)") for c in ("seq", "qual")}
    rows = rows.withColumns(cut)
    if exchange:
        turn = F.col("b.exchanged")
        rows = rows.withColumns({"seq": F.when(turn, S.revcomp("seq")).otherwise(F.col("seq")), "qual": F.when(turn, F.reverse("qual")).otherwise(F.col("qual"))})
    tag = F.when((F.col("b.fwd") < 0) | (F.col("b.rev") < 0), "UNDETERMINED").when(F.length("seq") < 1, "EMPTY").when(F.length("seq") < min_len, "SHORT").otherwise("NORMAL")
    return rows.select(*reads.columns, F.col("b.fwd").alias("fwd"), F.col("b.rev").alias("rev"), F.col("b.exchanged").alias("exchanged"), tag.alias("tag"))


def mate_pair(pairs: DataFrame, junction: str, min_len: int = 18, **options) -> DataFrame:
    return adapter.junction_cut(pairs, junction, min_len, **options)


def load(spark: SparkSession, path, fasta: bool | None = None) -> DataFrame:
    """Reads by file extension: FASTA, unaligned BAM or FASTQ, gzip included; ``read_id`` is the ordinal."""
    from ..sources import alignments, reads

    name = str(path).removesuffix(".gz").lower()
    if name.endswith(".bam"):
        rows = alignments.reads_of(alignments.read_bam(spark, path))
    elif fasta or (fasta is None and name.endswith((".fa", ".fasta"))):
        rows = reads.read_fasta(spark, path)
    else:
        rows = reads.read_fastq(spark, path)
    return rows.withColumn("read_id", F.col("ordinal"))

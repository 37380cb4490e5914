"""Simulated reads with known truth, sequence variants, and quality masking.

Fragments are drawn by a seeded generator for each Arrow batch of a range, and their bases are fetched
by an equi-join on (contig, chunk) with overlapping chunks of the reference, so no task holds a genome.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .chunks import chunks

CHUNK = 1 << 14
# Scores of the quality classes, where they begin, and the least sum that masks.
EAMSS = {"low": 1, "medium": 0, "high": -2, "medium_from": 15, "high_from": 30, "least": 1}
MOTIFS: tuple[str, ...] = ()


def _rng(seed: int, ids: np.ndarray) -> np.random.Generator:
    return np.random.default_rng([seed, int(ids[0]) if len(ids) else 0])


def draw_fragments(spark, contigs: DataFrame, n: int, insert_mean: float, insert_sd: float, seed: int = 1) -> DataFrame:
    """(read_id, chrom, pos, strand, insert_len): places in proportion to contig lengths."""
    sizes = contigs.select("chrom", F.length("seq").alias("size")).where("size > 0").orderBy("chrom").collect()  # names and lengths only
    names, lengths = [r["chrom"] for r in sizes], np.array([r["size"] for r in sizes], np.int64)
    ends = np.cumsum(lengths)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            r = _rng(seed, ids)
            size = np.maximum(0, np.rint(r.normal(insert_mean, insert_sd, len(ids)))).astype(np.int64)
            at = r.integers(0, ends[-1], len(ids))
            k = np.searchsorted(ends, at, "right")
            size = np.minimum(size, lengths[k])
            pos = np.minimum(at - (ends[k] - lengths[k]), lengths[k] - size)
            yield pd.DataFrame({"read_id": ids, "chrom": [names[i] for i in k], "pos": pos, "strand": np.where(r.random(len(ids)) < 0.5, "+", "-"), "insert_len": size.astype("int32")})

    return spark.range(n).mapInPandas(draw, "read_id long, chrom string, pos long, strand string, insert_len int")


def fetch(fragments: DataFrame, contigs: DataFrame, longest: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """``fragments`` with ``frag``, the bases of the insert on its strand."""
    parts = chunks(contigs.select("chrom", F.upper("seq").alias("seq")), chunk, 0, longest, spread=False)
    parts = parts.select("chrom", "chunk", F.col("text").alias("part"))
    rows = fragments.withColumn("chunk", F.floor(F.col("pos") / chunk)).join(parts, ["chrom", "chunk"])
    frag = F.expr(f"substring(part, int(pos % {chunk}) + 1, insert_len)")
    return rows.withColumn("frag", F.when(F.col("strand") == "+", frag).otherwise(S.revcomp(frag))).drop("chunk", "part")


def read_pairs(fragments: DataFrame, length: int, adapters: tuple[str, str]) -> DataFrame:
    """Error-free mates: insert, then adapter, then A; and the truth (the mate cut to the insert)."""
    fill = "A" * length
    mate = lambda frag, ad: F.substring(F.concat(frag, F.lit(ad), F.lit(fill)), 1, length)
    rows = fragments.withColumns({"r1": mate(F.col("frag"), adapters[0]), "r2": mate(S.revcomp("frag"), adapters[1])})
    keep = F.least("insert_len", F.lit(length))
    return rows.withColumns({"truth_len": keep, "answer1": F.substring(F.col("r1"), F.lit(1), keep), "answer2": F.substring(F.col("r2"), F.lit(1), keep)})


def with_errors(reads: DataFrame, seq: str, qual: str, transitions: dict[int, list[tuple[int, float]]] | None = None, start: int = 38, seed: int = 1, rate_scale: float = 1.0) -> DataFrame:
    """Qualities drawn by a Markov chain and substitutions at the rate they stand for; ``<seq>_subs`` has the truth.

    ``transitions`` maps a quality to (next quality, probability); the default drifts down slowly.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = _rng(seed, f["read_id"].to_numpy())
            seqs, quals, subs = [], [], []
            for text in f[seq]:
                n = len(text)
                if transitions:
                    q, now = np.empty(n, int), start
                    for i in range(n):
                        q[i] = now
                        options = transitions.get(now) or [(now, 1.0)]
                        now = options[int(r.choice(len(options), p=[p for _, p in options]))][0]
                else:
                    q = np.clip(start - np.cumsum(r.random(n) < 0.2) + r.integers(-2, 3, n), 2, 40)
                bases = np.frombuffer(text.encode(), np.uint8).copy()
                wrong = np.flatnonzero(r.random(n) < rate_scale * 10.0 ** (-q / 10))
                done = []
                for i in wrong:
                    other = [b for b in b"ACGT" if b != bases[i]]
                    new = other[int(r.integers(len(other)))]
                    done.append(f"{i},{chr(bases[i])}->{chr(new)}")
                    bases[i] = new
                seqs.append(bases.tobytes().decode())
                quals.append(bytes(q.astype(np.uint8) + 33).decode())
                subs.append(";".join(done))
            yield f.assign(**{seq: seqs, qual: quals, f"{seq}_subs": subs})

    schema = reads.drop(qual, f"{seq}_subs").withColumns({qual: F.lit(""), f"{seq}_subs": F.lit("")}).schema
    return reads.drop(qual, f"{seq}_subs").mapInPandas(call, schema)


def gc_accept(fragments: DataFrame, profile: dict[int, float], seed: int = 1, frag: str = "frag") -> DataFrame:
    """Keep a fragment with the relative depth of its GC percent (integer part) in ``profile``."""
    table = F.create_map(*[x for k, v in sorted(profile.items()) for x in (F.lit(k), F.lit(float(v)))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "read_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(F.try_element_at(table, F.floor(S.gc_percent(frag)).cast("int")), F.lit(1.0))
    return fragments.where(draw < share)


def apply_indels(text: str, indels: list[tuple[int, int, str]]) -> str:
    """Deletions (place, -n, "") and insertions (place, n, bases) applied from the right."""
    for at, n, bases in sorted(indels, reverse=True):
        text = text[:at] + (bases if n > 0 else "") + text[at + (0 if n > 0 else -n) :]
    return text


def diploid(contigs: DataFrame, snp: float = 0.001, indel: float = 0.0001, inversion: float = 0.0, inversion_len: int = 100, seed: int = 1) -> DataFrame:
    """(chrom, seq, variants): the second haplotype of each contig with SNPs, short indels and inversions.

    ``variants``: array of (pos, kind, ref, alt) on the given sequence. Transitions are twice as likely
    as transversions. N is never changed.
    """
    swap = {"A": "GCT", "G": "ACT", "C": "TAG", "T": "CAG"}

    def mutate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for chrom, text in zip(f["chrom"], f["seq"]):
                r = np.random.default_rng([seed, *chrom.encode()])
                n, out, found, last = len(text), [], [], 0
                kinds = r.random(n)
                for at in np.flatnonzero(kinds < snp + indel + inversion):
                    at = int(at)
                    ref = text[at]
                    if at < last or ref not in swap:
                        continue
                    if kinds[at] < snp:
                        alt = swap[ref][int(r.choice(3, p=[0.5, 0.25, 0.25]))]
                        out += [text[last:at], alt]
                        found.append((at, "SNP", ref, alt))
                        last = at + 1
                    elif kinds[at] < snp + indel:
                        size = int(r.geometric(0.5))
                        if r.random() < 0.5:
                            alt = "".join(r.choice(list("ACGT"), size))
                            out += [text[last:at], alt]
                            found.append((at, "INS", "", alt))
                            last = at
                        else:
                            ref = text[at : at + size]
                            out.append(text[last:at])
                            found.append((at, "DEL", ref, ""))
                            last = at + len(ref)
                    else:
                        ref = text[at : at + inversion_len]
                        alt = ref[::-1].translate(str.maketrans("ACGT", "TGCA"))
                        out += [text[last:at], alt]
                        found.append((at, "INV", ref, alt))
                        last = at + len(ref)
                out.append(text[last:])
                rows.append((chrom, "".join(out), [dict(zip(("pos", "kind", "ref", "alt"), v)) for v in found]))
            yield pd.DataFrame(rows, columns=["chrom", "seq", "variants"])

    return contigs.select("chrom", F.upper("seq").alias("seq")).mapInPandas(mutate, "chrom string, seq string, variants array<struct<pos:int,kind:string,ref:string,alt:string>>")


def quality_mask(qual: list[int], seq: str, rule: dict = EAMSS, motifs: tuple[str, ...] = MOTIFS) -> int:
    """Where the masked suffix begins; the read length if nothing is masked.

    Scores are summed from the end; the farthest place with the best sum starts the mask if that sum is
    high enough. It is moved back to a motif within 15 bases before it, and over a run with 90 % G.
    """
    values = np.asarray(qual)
    score = np.where(values >= rule["high_from"], rule["high"], np.where(values >= rule["medium_from"], rule["medium"], rule["low"]))
    total = np.cumsum(score[::-1])
    if not len(total) or total.max() < rule["least"]:
        return len(seq)
    at = len(seq) - 1 - int(np.flatnonzero(total == total.max())[-1])
    found = [i for i in (seq.find(m, max(0, at - 15), at) for m in motifs) if i >= 0]
    at = min([at, *found])
    run = np.cumsum(np.frombuffer(seq[: at + 1][::-1].encode(), np.uint8) == ord("G"))
    start = at
    for k in range(9, len(run)):
        if 10 * int(run[k]) < 9 * (k + 1):
            break
        if seq[at - k] == "G":
            start = at - k
    return start


def masked_from(seq: str = "seq", qual: str = "qual", base: int = 33) -> Column:
    @F.pandas_udf("int")
    def run(s: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([quality_mask([ord(c) - base for c in y], x) for x, y in zip(s, q)], dtype="int32")

    return run(F.col(seq), F.col(qual))


def load_profile(spark, path: str, keys: int, comment: str = "#"):
    """Rows of a numeric profile table: ``keys`` leading integer columns, then values."""
    from ..sources.annotations import _fields

    rows = _fields(spark, path, comment, r"\s+")
    ints = [F.col("c")[i].cast("double").alias(f"k{i}") for i in range(keys)]
    return rows.select(*ints, F.transform(F.expr(f"slice(c, {keys + 1}, size(c))"), lambda x: x.cast("double")).alias("values"))

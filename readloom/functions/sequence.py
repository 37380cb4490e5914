"""Column expressions on bases, qualities, flags, CIGARs and bins; inside the JVM but for quality sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Complements of the 16 IUPAC codes.
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
IUPAC_COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"

# Alignment flag bits.
FLAGS = {
    "paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "first": 64, "last": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048,
}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq) -> Column:
    """Reverse complement; acgt become upper case, other characters stay."""
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCATGCA"))


def complement(seq) -> Column:
    return F.translate(col(seq), "ACGTacgt", "TGCATGCA")


def head_adapter(seq, at_head: bool = True) -> Column:
    """Reads whose adapter is at the head are complemented before the search, others stay."""
    return complement(seq) if at_head else col(seq)


def iupac_revcomp(seq) -> Column:
    return F.reverse(F.translate(col(seq), IUPAC, IUPAC_COMPLEMENT))


def count_chars(seq, chars: str) -> Column:
    s = col(seq)
    return F.length(s) - F.length(F.translate(s, chars, ""))


def gc_percent(seq) -> Column:
    """G and C as percent of known bases; null without known bases."""
    known = F.length(col(seq)) - count_chars(seq, "Nn")
    return F.when(known > 0, 100.0 * count_chars(seq, "GCgc") / known)


def match_count(a, b) -> Column:
    """Equal bases over the shorter length; N never matches."""
    pair = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: (x.eqNullSafe(y) & (x != "N") & x.isNotNull()).cast("int"))
    return F.aggregate(pair, F.lit(0), lambda s, x: s + x)


def hamming(a, b) -> Column:
    """Unequal bases over the shorter length."""
    return F.least(F.length(col(a)), F.length(col(b))) - match_count(a, b)


def is_blurry(seq, epsilon: float = 0.1) -> Column:
    """More than ceil(epsilon * length) characters are none of ACGTU."""
    s = col(seq)
    return F.length(F.translate(s, "ACGTUacgtu", "")) > F.ceil(F.lit(epsilon) * F.length(s))


def byte_sums(text: pa.Array) -> np.ndarray:
    """Sum of the bytes of each string of an Arrow column; 0 for null."""
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text) or text.buffers()[2] is None:
        return np.zeros(len(text), np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    total = np.concatenate([[0], np.cumsum(np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]], dtype=np.int64)])
    return total[at[1:] - at[0]] - total[at[:-1] - at[0]]


def quality_sum(qual, base: int = 33) -> Column:
    """Sum of quality values, over whole Arrow batches: a lambda for each character costs about 20 times as much."""

    @F.arrow_udf(T.LongType())
    def total(q: pa.Array) -> pa.Array:
        return pa.array(byte_sums(q))

    return total(col(qual)) - base * F.length(col(qual))


def quality_sum_expr(qual, base: int = 33) -> Column:
    """The same by built-in functions alone."""
    values = F.transform(F.split(col(qual), ""), lambda c: F.ascii(c) - base)
    return F.when(F.length(col(qual)) > 0, F.aggregate(values, F.lit(0), lambda s, x: s + x)).otherwise(F.length(col(qual)))


def mean_quality(qual, base: int = 33) -> Column:
    """Mean quality; null for an empty string."""
    n = F.length(col(qual))
    return F.when(n > 0, quality_sum(qual, base) / n)


def quality_passes(qual, least: float, base: int = 33) -> Column:
    """Mean quality of at least ``least``; an empty string passes."""
    n = F.length(col(qual))
    return F.when(n > 0, quality_sum(qual, base) >= F.lit(least) * n).otherwise(True)


def quality_trim3(qual, least: int, base: int = 33) -> Column:
    """Length left when 3' bases are dropped until one has at least ``least``."""
    low = "".join(map(chr, range(33, base + least)))
    return F.length(F.rtrim(col(qual), F.lit(low))) if low else F.length(col(qual))


def low_complexity(seq, k: int, share: float = 0.7) -> Column:
    """One base makes up at least ``share`` of the first ``k`` bases."""
    head = F.substring(col(seq), 1, k)
    return F.greatest(*[count_chars(head, b) for b in "ACGT"]) >= F.lit(share) * k


def masked(seq, pos) -> Column:
    """Bases from ``pos`` on in lower case."""
    s, p = col(seq), col(pos)
    return F.concat(F.substring(s, F.lit(1), p), F.lower(F.substring(s, p + 1, F.length(s))))


def n_filled(seq, pos) -> Column:
    s, p = col(seq), col(pos)
    return F.rpad(F.substring(s, F.lit(1), p), F.length(s), "N")


def quality_filled(qual, pos) -> Column:
    q, p = col(qual), col(pos)
    return F.rpad(F.substring(q, F.lit(1), p), F.length(q), "!")


def penalty(q) -> Column:
    """Mismatch cost of a quality value: 0.477 at or below 0, +0.1 for each step, 4.477 above 39."""
    v = col(q)
    return F.when(v <= 0, 0.477).when(v > 39, 4.477).otherwise(0.477 + v / 10.0)


def error_rate(q) -> Column:
    return F.pow(F.lit(10.0), -col(q) / 10.0)


def phred(p) -> Column:
    return -10 * F.log10(col(p))


def flag(flags, name: str) -> Column:
    return col(flags).bitwiseAND(FLAGS[name]) != 0


def reg2bin(begin, end) -> Column:
    """Bin of the half-open interval [begin, end) in the five-level 16 kb to 512 Mb scheme."""
    b, e = col(begin).cast("long"), col(end).cast("long") - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), F.shiftright(b, shift) + first).otherwise(out)
    return out.cast("int")


def reg2bins(begin, end) -> Column:
    """All bins that may hold intervals overlapping [begin, end)."""
    b, e = col(begin).cast("long"), col(end).cast("long") - 1
    levels = [F.array(F.lit(0).cast("long"))]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        levels.append(F.sequence(F.shiftright(b, shift) + first, F.shiftright(e, shift) + first))
    return F.concat(*levels)


def cigar_ops(cigar) -> Column:
    """array<struct<op, len>> of a CIGAR string; ``*`` is empty."""
    c = col(cigar)
    ops, sizes = (F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(i)) for i in (2, 1))
    return F.zip_with(ops, sizes, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))


def cigar_text(ops) -> Column:
    text = F.concat_ws("", F.transform(col(ops), lambda x: F.concat(x["len"].cast("string"), x["op"])))
    return F.when(F.size(col(ops)) > 0, text).otherwise("*")


def cigar_length(ops, kinds: str) -> Column:
    part = F.filter(col(ops), lambda x: F.lit(kinds).contains(x["op"]))
    return F.aggregate(part, F.lit(0), lambda s, x: s + x["len"])


def reference_length(ops) -> Column:
    """Reference bases that an alignment consumes."""
    return cigar_length(ops, "MDN=X")


def query_length(ops) -> Column:
    return cigar_length(ops, "MIS=X")


def pack_kmer(kmer) -> Column:
    """A k-mer of up to 31 bases as a long, two bits a base (A0 C1 G2 T3)."""
    codes = F.transform(F.split(F.translate(col(kmer), "ACGT", "0123"), ""), lambda c: c.cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s * 4 + x)


def unpack_kmer(code, k: int) -> Column:
    c = col(code)
    parts = [F.substring(F.lit("ACGT"), F.shiftright(c, 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in reversed(range(k))]
    return F.concat(*parts)


def name_key(name) -> Column:
    """A read name up to its first space or slash."""
    return F.split(col(name), "[ /]")[0]


def read_number(name) -> Column:
    """The number at the end of a read name, before an optional /1 or /2."""
    return F.regexp_extract(col(name), r"(\d+)(?:/[12])?$", 1).cast("long")


def n_runs(seq) -> Column:
    """array<struct<start, len>> of the runs of N, 0-based."""
    s = col(seq)
    runs = F.regexp_extract_all(s, F.lit("([^Nn]*)([Nn]+)"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("out"))

    def step(acc, r):
        n = F.length(r) - F.length(F.regexp_replace(r, "[Nn]+$", ""))
        start = acc["at"] + F.length(r) - n
        return F.struct((acc["at"] + F.length(r)).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), n.alias("len")))).alias("out"))

    return F.aggregate(runs, zero, step, lambda acc: acc["out"])


def kmers(seq, k: int) -> Column:
    """array<struct<pos, kmer>>; empty when the sequence is shorter than k."""
    s = col(seq)
    at = F.sequence(F.lit(0), F.greatest(F.length(s) - k, F.lit(0)))
    return F.when(F.length(s) >= k, F.transform(at, lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))

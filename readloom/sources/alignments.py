"""SAM text and BAM: reading, writing, and conversion to reads and BED rows.

A BAM file is decoded whole by one task (files of up to 2 GB): BGZF blocks are inflated and records
parsed with struct. Region reads filter on the place; tables written with ``bin`` as a partition
column prune instead. Qualities of BAM stay raw inside the file and are shifted by 33 here.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from .framing import numbered

# Order of the 4-bit base codes and of the CIGAR codes.
BASES = "=ACMGRSVTWYHKDBN"
CIGAR = "MIDNSHP=X"
_TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_STRUCT = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SCHEMA = (
    "file string, ordinal long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, "
    "seq string, qual string, tags array<struct<tag:string,type:string,value:string>>, bin int"
)


def read_sam(spark: SparkSession, path) -> DataFrame:
    """Typed columns of SAM lines (places are 1-based); ``tags`` is an array of (tag, type, value)."""
    rows = numbered(spark, path).where(~F.col("value").startswith("@")).select("line", F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("c"))
    text = lambda i, n: F.col("c")[i].alias(n)
    num = lambda i, n: F.col("c")[i].cast("int").alias(n)
    tags = F.transform(F.expr("slice(c, 12, greatest(size(c) - 11, 0))"), lambda t: F.struct(F.split(t, ":", 3)[0].alias("tag"), F.split(t, ":", 3)[1].alias("type"), F.split(t, ":", 3)[2].alias("value")))
    return rows.select(
        F.col("line").alias("ordinal"), text(0, "qname"), num(1, "flag"), text(2, "rname"), num(3, "pos"), num(4, "mapq"), text(5, "cigar"),
        text(6, "rnext"), num(7, "pnext"), num(8, "tlen"), text(9, "seq"), text(10, "qual"), tags.alias("tags"),
    )


def sam_header(spark: SparkSession, path) -> DataFrame:
    """(line, kind, fields) of header lines."""
    rows = numbered(spark, path).where(F.col("value").startswith("@"))
    parts = F.split("value", "\t")
    return rows.select("line", F.expr("substring(split(value, '\t')[0], 2)").alias("kind"), F.slice(parts, 2, 1000).alias("fields"))


def sam_text() -> Column:
    """One SAM line of the columns of ``read_sam``."""
    tags = F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"]))
    fields = [F.col(c).cast("string") for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    return F.concat_ws("\t", *fields, F.when(F.size("tags") > 0, F.array_join(tags, "\t")))


def inflate(data: bytes) -> bytes:
    """All BGZF blocks of a file."""
    out, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(31)
        out.append(z.decompress(data[at:]))
        left = len(z.unused_data)
        at = len(data) - left
        if not left:
            break
    return b"".join(out)


def deflate(data: bytes) -> bytes:
    """BGZF blocks with their closing empty block."""
    out = []
    for a in [*range(0, len(data), 60_000), None]:
        part = data[a : a + 60_000] if a is not None else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(part), len(part)))
    return b"".join(out)


def _tags(raw: bytes) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            numbers = struct.unpack_from(f"<{n}{_TAG_STRUCT[sub]}", raw, at + 5)
            value, at = ",".join([sub, *map(str, numbers)]), at + 5 + n * _TAG_SIZES[sub]
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        else:
            value, at = str(struct.unpack_from(f"<{_TAG_STRUCT[kind]}", raw, at)[0]), at + _TAG_SIZES[kind]
        out.append((tag, kind if kind in "AZHBf" else "i", value))
    return out


def parse_bam(data: bytes) -> Iterator[tuple]:
    """Records of an inflated BAM: the columns of ``SCHEMA`` after ``file`` and ``ordinal``; places 0-based."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n_ref = struct.unpack_from("<i", data, at)[0]
    at, refs = at + 4, []
    for _ in range(n_ref):
        size = struct.unpack_from("<i", data, at)[0]
        refs.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    name = lambda i: refs[i] if 0 <= i < len(refs) else "*"
    while at < len(data):
        size, ref, pos, l_name, mapq, bin_, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        p, end = at + 36, at + 4 + size
        qname = data[p : p + l_name - 1].decode()
        p += l_name
        cigar = "".join(f"{x >> 4}{CIGAR[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, p)) or "*"
        p += 4 * n_cigar
        packed = data[p : p + (l_seq + 1) // 2]
        seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:l_seq] or "*"
        p += (l_seq + 1) // 2
        raw = data[p : p + l_seq]
        qual = "*" if not l_seq or raw[0] == 255 else bytes(q + 33 for q in raw).decode("latin-1")
        tags = _tags(data[p + l_seq : end])
        long_cigar = next((v for t, k, v in tags if t == "CG" and k == "B"), None)
        if long_cigar and re.fullmatch(r"\d+S\d+N", cigar):
            cigar = "".join(f"{int(x) >> 4}{CIGAR[int(x) & 15]}" for x in long_cigar.split(",")[1:])
            tags = [t for t in tags if t[0] != "CG"]
        mate = "=" if next_ref == ref and ref >= 0 else name(next_ref)
        yield qname, flag, name(ref), pos, mapq, cigar, mate, next_pos, tlen, seq, qual, tags, bin_
        at = end


def read_bam(spark: SparkSession, path, region: tuple[str, int, int] | None = None, end_by: str = "cigar") -> DataFrame:
    """BAM records. ``region`` (chrom, begin, end), 0-based half open; ``end_by="qual"`` takes a read's
    end from the number of its qualities instead of its CIGAR."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]
        for f in frames:
            for file, content in zip(f["path"], f["content"]):
                rows = []
                for i, r in enumerate(parse_bam(inflate(content))):
                    rows.append((file, i, *r[:11], [dict(zip(("tag", "type", "value"), t)) for t in r[11]], r[12]))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    out = files.mapInPandas(decode, SCHEMA)
    if region:
        chrom, begin, end = region
        size = F.length("qual") if end_by == "qual" else S.reference_length(S.cigar_ops("cigar"))
        out = out.where((F.col("rname") == chrom) & (F.col("pos") < end) & (F.col("pos") + F.greatest(size, F.lit(1)) > begin))
    return out


def bam_bytes(refs: list[tuple[str, int]], records: list[dict], header: str = "") -> bytes:
    """A BAM file of records with the columns of ``SCHEMA``; tags of kinds A, i, f, Z and H."""
    ids = {n: i for i, (n, _) in enumerate(refs)}
    out = [b"BAM\1", struct.pack("<i", len(header)), header.encode(), struct.pack("<i", len(refs))]
    for n, size in refs:
        out.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size))
    for r in records:
        seq = "" if r["seq"] == "*" else r["seq"]
        ops = [(int(n), CIGAR.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])]
        codes = [BASES.index(c) if c in BASES else 15 for c in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        qual = bytes([255] * len(seq)) if r["qual"] == "*" else bytes(ord(c) - 33 for c in r["qual"])
        tags = b""
        for t in r.get("tags") or ():
            kind = t["type"]
            value = struct.pack("<i", int(t["value"])) if kind == "i" else struct.pack("<f", float(t["value"])) if kind == "f" else t["value"].encode() + (b"\0" if kind in "ZH" else b"")
            tags += t["tag"].encode() + kind.encode() + value
        ref = ids.get(r["rname"], -1)
        mate = ref if r["rnext"] == "=" else ids.get(r["rnext"], -1)
        name = r["qname"].encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, r["pos"], len(name), r["mapq"], r.get("bin") or 4680, len(ops), r["flag"], len(seq), mate, r["pnext"], r["tlen"])
        body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual + tags
        out.append(struct.pack("<i", len(body)) + body)
    return deflate(b"".join(out))


def reads_of(bam: DataFrame) -> DataFrame:
    """(ordinal, name, seq, qual) as sequenced: reverse-strand records are turned back."""
    back = S.flag("flag", "reverse")
    return bam.select("ordinal", F.col("qname").alias("name"), F.when(back, S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def pairs_of(bam: DataFrame) -> DataFrame:
    """Mates of a file in which they alternate."""
    r = reads_of(bam).withColumn("pair", F.floor(F.col("ordinal") / 2))
    one, two = (r.where(F.col("ordinal") % 2 == i - 1).select(F.col("pair").alias("ordinal"), F.col("name").alias(f"n{i}"), F.col("seq").alias(f"r{i}"), F.col("qual").alias(f"q{i}")) for i in (1, 2))
    return one.join(two, "ordinal")


def _each(rows: DataFrame) -> DataFrame:
    """One row a locus ``l``, with the number of them."""
    if "loci" in rows.columns:
        return rows.withColumn("n_loci", F.size("loci")).withColumn("l", F.explode("loci"))
    return rows.withColumn("l", F.struct("chrom", "pos"))


def aligned_sam(rows: DataFrame) -> DataFrame:
    """SAM columns of seed alignments: one row a locus, from ``loci`` (an array of chrom, pos), or from rows with
    ``chrom``, ``pos`` and ``n_loci``.

    CIGAR is prefix and soft-clipped tail, MAPQ 255 less the tail's length, tags NH, MD (with a mismatch:
    ``mismatch_at`` and the reference's base ``alt``, both along the read) and TL; reads on the minus strand are
    printed reverse complemented.
    """
    tail, back = F.length("tail"), F.col("strand") == "-"
    each = _each(rows)
    clip = F.when(tail > 0, F.concat(tail.cast("string"), F.lit("S"))).otherwise("")
    body = F.concat(F.col("prefix_len").cast("string"), F.lit("M"))
    tag = lambda t, k, v: F.struct(F.lit(t).alias("tag"), F.lit(k).alias("type"), v.cast("string").alias("value"))
    tags = [tag("NH", "i", F.col("n_loci"))]
    if "mismatch_at" in rows.columns:
        front, rest = F.col("mismatch_at"), (F.col("prefix_len") - F.col("mismatch_at") - 1).cast("string")
        first = F.when(front > 0, front.cast("string")).otherwise("")
        md = F.when(back, F.concat(rest, S.complement(F.col("alt")), first)).otherwise(F.concat(first, F.col("alt"), rest))
        tags.append(F.when(front.isNotNull(), tag("MD", "Z", md)))
    tags.append(F.when(tail > 0, tag("TL", "Z", F.col("tail"))))
    return each.select(
        F.col("name").alias("qname"), F.when(back, 16).otherwise(0).alias("flag"), F.col("l.chrom").alias("rname"), (F.col("l.pos") + 1).cast("int").alias("pos"),
        (255 - tail).alias("mapq"), F.when(back, F.concat(clip, body)).otherwise(F.concat(body, clip)).alias("cigar"), F.lit("*").alias("rnext"),
        F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), F.when(back, S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), F.array_compact(F.array(*tags)).alias("tags"),
    )


def to_bed(rows: DataFrame, count: str = "n") -> DataFrame:
    """(chrom, begin, stop, strand, name, tail, reads) a locus; reads are shared equally among loci."""
    each = _each(rows)
    return each.select(F.col("l.chrom").alias("chrom"), F.col("l.pos").alias("begin"), (F.col("l.pos") + F.col("prefix_len")).alias("stop"), "strand", "name", "tail", (F.col(count) / F.col("n_loci")).alias("reads"))


# -- region index: bins as partition folders -----------------------------------------------------------------


def write_binned(bam: DataFrame, path: str) -> None:
    """Alignments in folders by reference and bin, so that region reads open only bins that can overlap."""
    end = F.col("pos") + F.greatest(S.reference_length(S.cigar_ops("cigar")), F.lit(1))
    rows = bam.withColumn("bin", F.when(F.col("pos") >= 0, S.reg2bin("pos", end)).otherwise(4680)).withColumn("end_pos", end)
    rows.repartition("rname", "bin").sortWithinPartitions("pos").write.partitionBy("rname", "bin").parquet(path)


def read_binned(spark: SparkSession, path: str, chrom: str, begin: int, end: int) -> DataFrame:
    """Alignments that overlap [begin, end), 0-based; other folders are pruned."""
    bins = [0]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        bins += range(first + (begin >> shift), first + ((end - 1) >> shift) + 1)
    rows = spark.read.parquet(path).where((F.col("rname") == chrom) & F.col("bin").isin(bins))
    return rows.where((F.col("pos") < end) & (F.col("end_pos") > begin)).drop("end_pos")

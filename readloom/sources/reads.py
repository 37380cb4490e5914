"""FASTQ and FASTA: reading, validity, pairing, quality encoding; and ordered sinks.

gzip files are decoded by Spark's text reader (one task a file); zip files by an Arrow pass over
binary files. Bases are folded to upper case; other characters than ACGTN make a record invalid.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.chunks import chunks
from .framing import framed, global_ordinal, numbered


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, "\r$", "")


def read_fastq(spark: SparkSession, path, invalid: str = "error", strict: bool = True) -> DataFrame:
    """(ordinal, name, seq, qual). ``invalid``: ``error``, ``drop`` or ``keep`` (with ``problem``).

    ``strict`` also asks for a repeated name on line 3 to be the name, for quality characters in
    ``!``..``~`` and for bases in ACGTN.
    """
    rec = global_ordinal(framed(numbered(spark, path), 4))
    at = lambda i: _clean(F.get("lines", F.lit(i)))
    rows = rec.select("ordinal", at(0).alias("h"), F.upper(at(1)).alias("seq"), at(2).alias("p"), at(3).alias("qual"))
    return _validated(rows, invalid, strict).select("ordinal", F.expr("substring(h, 2)").alias("name"), "seq", "qual", *(["problem"] if invalid == "keep" else []))


def _validated(rows: DataFrame, invalid: str, strict: bool) -> DataFrame:
    problem = (
        F.when(~F.coalesce(F.col("h").startswith("@"), F.lit(False)), "line 1 has no @")
        .when(~F.coalesce(F.col("p").startswith("+"), F.lit(False)), "line 3 has no +")
        .when(~F.coalesce(F.length("seq") == F.length("qual"), F.lit(False)), "bases and qualities differ in length")
    )
    if strict:
        problem = (
            problem.when((F.length("p") > 1) & (F.expr("substring(p, 2)") != F.expr("substring(h, 2)")), "line 3 has another name")
            .when(F.col("qual").rlike("[^!-~]"), "a quality is out of range")
            .when(F.col("seq").rlike("[^ACGTN]"), "a base is none of ACGTN")
        )
    rows = rows.withColumn("problem", problem)
    if invalid == "drop":
        return rows.where("problem IS NULL")
    if invalid == "keep":
        return rows
    check = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("record "), F.col("ordinal").cast("string"), F.lit(": "), F.col("problem"))).cast("string"))
    return rows.withColumn("seq", F.coalesce(check, F.col("seq")))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(ordinal, name, seq) of FASTA with any number of lines a record; ``qual`` is null.

    A record is what stands between ``>`` at line starts.
    """
    rec = global_ordinal(numbered(spark, path, "\n>"), "line")
    text = F.regexp_replace("value", "^>", "")
    rows = rec.select("ordinal", _clean(F.split(text, "\n", 2)[0]).alias("name"), F.upper(F.regexp_replace(F.get(F.split(text, "\n", 2), F.lit(1)), r"\s", "")).alias("seq"))
    return rows.select("ordinal", "name", F.coalesce("seq", F.lit("")).alias("seq"), F.lit(None).cast("string").alias("qual"))


def read_contigs(spark: SparkSession, path) -> DataFrame:
    """(chrom, chrom_ord, seq): the name up to its first white space."""
    return read_fasta(spark, path).select(F.split("name", r"\s")[0].alias("chrom"), F.col("ordinal").cast("int").alias("chrom_ord"), "seq")


def chunked(contigs: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chrom, chunk_no, chunk_start, seq) for long sequences."""
    return chunks(contigs, size, spread=False).select("chrom", F.col("chunk").cast("int").alias("chunk_no"), F.col("first").alias("chunk_start"), F.col("text").alias("seq"))


def read_adapters(spark: SparkSession, path, most: int = 96, longest: int = 64) -> list[tuple[int, str, str]]:
    """(idx, name, seq) of an adapter FASTA, at most ``most`` sequences cut to ``longest`` bases."""
    rows = read_fasta(spark, path).orderBy("ordinal").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} adapters")
    return [(i, r["name"], r["seq"][:longest]) for i, r in enumerate(rows)]


def read_pair_matrix(spark: SparkSession, path) -> DataFrame:
    """(row_name, col_name, valid) of a tab-separated 0/1 matrix with column names in its first line."""
    rows = numbered(spark, path).where(~F.col("value").startswith("%%")).select("line", F.split(_clean(F.col("value")), "\t").alias("c"))
    head = rows.orderBy("line").limit(1).select(F.col("line").alias("head"), F.col("c").alias("names"))
    body = rows.crossJoin(F.broadcast(head)).where("line > head")  # one header row
    cells = body.select(F.col("c")[0].alias("row_name"), F.explode(F.arrays_zip(F.expr("slice(names, 2, size(names))").alias("col_name"), F.expr("slice(c, 2, size(c))").alias("v"))).alias("x"))
    return cells.select("row_name", F.col("x.col_name").alias("col_name"), (F.col("x.v") == "1").alias("valid"))


def read_zip(spark: SparkSession, path) -> DataFrame:
    """(file, member, line, value): text lines of zip archives, one task an archive."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in z.namelist():
                        text = z.read(member).decode().splitlines()
                        yield pd.DataFrame({"file": name, "member": member, "line": range(len(text)), "value": text})

    return rows.mapInPandas(unpack, "file string, member string, line long, value string")


def pair_up(first: DataFrame, second: DataFrame, check: bool = True) -> DataFrame:
    """(ordinal, n1, r1, q1, n2, r2, q2): mates by ordinal. Unequal counts are an error if ``check``."""
    if check:
        a, b = first.count(), second.count()
        if a != b:
            raise ValueError(f"{a} first and {b} second mates")
    one, two = (d.select("ordinal", F.col("name").alias(f"n{i}"), F.col("seq").alias(f"r{i}"), F.col("qual").alias(f"q{i}")) for i, d in ((1, first), (2, second)))
    return one.join(two, "ordinal")


def quality_encoding(*files: DataFrame) -> str:
    """``sanger`` (the first decisive character is below 59), ``solexa`` (above 74), ``fasta`` (no qualities) or
    ``unknown``; files that differ are an error."""
    told = set()
    for reads in files:
        mark = F.regexp_extract("qual", "[^;-J]", 0)
        first = reads.agg(F.min_by(F.when(F.col("qual").isNull(), "").otherwise(mark), F.when(F.col("qual").isNull() | (mark != ""), F.col("ordinal"))).alias("c")).first()["c"]
        told.add("unknown" if first is None else "fasta" if first == "" else "sanger" if first < ";" else "solexa")
    told = told - {"unknown"} or {"unknown"}
    if len(told) > 1:
        raise ValueError("files of several quality encodings")
    return told.pop()


def concatenated(*tables: DataFrame) -> DataFrame:
    """Records of several inputs one after another, ordinals going on."""
    out, n = None, 0
    for t in tables:
        part = t.withColumn("ordinal", (F.col("ordinal") + n).cast("long"))
        out = part if out is None else out.unionByName(part)
        n += t.count()
    return out


def longest_read(reads: DataFrame, first: int = 100) -> int:
    return reads.orderBy("ordinal").limit(first).agg(F.max(F.length("seq"))).first()[0] or 0


# -- sinks ------------------------------------------------------------------------------------------------


def fastq_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), F.col("seq"), F.lit("+"), F.col("qual"))


def fasta_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), F.col("name")), F.col("seq"))


def write_reads(reads: DataFrame, path: str, fasta: bool = False, ordinal: str | None = "ordinal", gzip: bool = False, partition_by: str | None = None) -> None:
    """Records in input order: part files follow one another by ordinal. With ``partition_by`` one folder a value."""
    text = (fasta_text() if fasta else fastq_text()).alias("value")
    rows = reads.orderBy(ordinal) if ordinal else reads
    out = rows.select(text, *([partition_by] if partition_by else [])).write.option("compression", "gzip" if gzip else "none")
    (out.partitionBy(partition_by) if partition_by else out).text(path)


def barcode_records(reads: DataFrame, barcode_len: int) -> DataFrame:
    """Barcode reads: the first bases of every read as records of their own."""
    head = lambda c: F.substring(c, 1, barcode_len)
    return reads.withColumns({"seq": head("seq"), "qual": head("qual")})


def mapping_table(spark: SparkSession, samples: list[tuple[str, str]]) -> DataFrame:
    """Lines of a sample mapping file."""
    text = ["#SampleID\tBarcodeSequence\tLinkerPrimerSequence\tDescription", *(f"{n}\t{b}\t\t{n}" for n, b in samples)]
    return spark.createDataFrame([(t,) for t in text], "value string")

"""VCF, GFF, BED, BedGraph and WIG: readers, writers, and interval adaptors (closed, 0-based)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .framing import numbered


def _fields(spark: SparkSession, path, comment: str = "#", sep: str = "\t") -> DataFrame:
    rows = numbered(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    return rows.where(~F.col("value").startswith(comment)).select("file", "line", F.split("value", sep).alias("c"))


def _pick(kinds: str) -> list[Column]:
    """Columns of ``c`` by a list like ``chrom string, pos int``."""
    return [F.get("c", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(x.split() for x in kinds.split(", "))]


def read_vcf(spark: SparkSession, path) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info (map) and samples (map of name to its fields)."""
    rows = _fields(spark, path, "##")
    names = rows.where(F.col("c")[0] == "#CHROM").select("file", F.expr("slice(c, 10, greatest(size(c) - 9, 0))").alias("names"))
    body = rows.where(~F.col("c")[0].startswith("#")).join(F.broadcast(names), "file", "left")
    info = F.when(F.get("c", F.lit(7)).isin(".", ""), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(F.get("c", F.lit(7)), F.lit(";"), F.lit("=")))
    values = F.transform(F.expr("slice(c, 10, greatest(size(c) - 9, 0))"), lambda x: F.split(x, ":"))
    qual = F.when(F.get("c", F.lit(5)) != ".", F.get("c", F.lit(5))).cast("float")
    first = [F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("chrom", "pos", "id", "ref", "alt"))]
    first[1] = F.get("c", F.lit(1)).cast("int").alias("pos")
    return body.select(*first, qual.alias("qual"), F.get("c", F.lit(6)).alias("filter"), info.alias("info"), F.map_from_arrays(F.coalesce("names", F.array().cast("array<string>")), values).alias("samples"))


def vcf_header(spark: SparkSession, path) -> DataFrame:
    """(line, key, value) of the ``##`` lines."""
    rows = numbered(spark, path).where(F.col("value").startswith("##"))
    return rows.select("line", F.regexp_extract("value", "^##([^=]*)=?(.*)$", 1).alias("key"), F.regexp_extract("value", "^##([^=]*)=?(.*)$", 2).alias("value"))


def vcf_text() -> Column:
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot(F.col("id")), "ref", "alt", dot(F.col("qual")), dot(F.col("filter")), F.when(F.size("info") > 0, info).otherwise("."))


def read_gff(spark: SparkSession, path) -> DataFrame:
    """Nine columns; what follows ``##FASTA`` is left out."""
    rows = numbered(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    end = rows.where(F.col("value").startswith("##FASTA")).groupBy("file").agg(F.min("line").alias("end__"))
    body = rows.join(F.broadcast(end), "file", "left").where("end__ IS NULL OR line < end__").where(~F.col("value").startswith("#"))
    return body.select(F.split("value", "\t").alias("c")).select(*_pick("seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"))


def gff_attributes(attributes: str = "attributes") -> Column:
    return F.str_to_map(F.col(attributes), F.lit(";"), F.lit("="))


def read_bed6(spark: SparkSession, path) -> DataFrame:
    return _fields(spark, path).select(*_pick("chrom string, start int, end int, strand string, gene_type string, anno_seed string"))


def read_bedgraph(spark: SparkSession, path) -> DataFrame:
    rows = _fields(spark, path, sep=r"\s+").where(~F.col("c")[0].isin("track", "browser"))
    return rows.select(*_pick("chrom string, start int, end int, score float"))


_LINES = 4096


def read_wig(spark: SparkSession, path) -> DataFrame:
    """(chrom, pos, span, value) of fixedStep and variableStep sections; positions as in the file (1-based).

    The first line must declare a wiggle track. A section is known in each run of ``_LINES`` lines that it reaches into,
    so lines meet their section by an equi-join on the run.
    """
    rows = numbered(spark, path).withColumn("value", F.trim(F.regexp_replace("value", "\r$", "")))
    bad = rows.where("line = 0").where(~F.col("value").rlike("^track +type=wiggle_0")).limit(1).count()
    if bad:
        raise ValueError("a WIG file must begin with: track type=wiggle_0")
    step = F.col("value").rlike("^(fixedStep|variableStep)")
    pick = lambda key, other: F.coalesce(F.nullif(F.regexp_extract("value", rf"\b{key}=(\S+)", 1), F.lit("")), F.lit(other))
    sections = rows.where(step).select(
        "file", F.col("line").alias("head"), F.col("value").startswith("fixed").alias("fixed"), pick("chrom", "").alias("chrom"),
        pick("start", "1").cast("long").alias("start"), pick("step", "1").cast("long").alias("step"), pick("span", "1").cast("int").alias("span"),
    )
    last = rows.groupBy("file").agg((F.max("line") + 1).alias("last"))
    sections = sections.withColumn("next", F.lead("head").over(Window.partitionBy("file").orderBy("head"))).join(last, "file").withColumn("next", F.coalesce("next", "last")).drop("last")
    runs = F.sequence(F.floor(F.col("head") / _LINES), F.floor((F.col("next") - 1) / _LINES))
    body = rows.where(~step & ~F.col("value").rlike("^(track|browser|#)")).withColumn("run", F.floor(F.col("line") / _LINES))
    body = body.join(sections.withColumn("run", F.explode(runs)), ["file", "run"]).where("line > head AND line < next")
    place = F.when(F.col("fixed"), F.col("start") + (F.col("line") - F.col("head") - 1) * F.col("step")).otherwise(F.split("value", r"\s+")[0].cast("long"))
    return body.select("chrom", place.alias("pos"), "span", F.element_at(F.split("value", r"\s+"), -1).cast("double").alias("value"))


# -- interval adaptors: (chrom, begin, stop, ...), closed and 0-based -----------------------------------------


def vcf_intervals(vcf: DataFrame) -> DataFrame:
    return vcf.select("chrom", (F.col("pos") - 1).cast("long").alias("begin"), (F.col("pos") + F.length("ref") - 2).cast("long").alias("stop"), "id", "ref", "alt")


def gff_intervals(gff: DataFrame) -> DataFrame:
    return gff.select(F.col("seqid").alias("chrom"), (F.col("start") - 1).cast("long").alias("begin"), (F.col("end") - 1).cast("long").alias("stop"), F.col("type").alias("gene_type"), "strand", "attributes")


def bed_intervals(bed: DataFrame, one_based: bool = True) -> DataFrame:
    """BED starts are taken as 1-based, as annotation tables of this kind have them."""
    start = F.col("start") - (1 if one_based else 0)
    return bed.select("chrom", start.cast("long").alias("begin"), (F.col("end") - 1).cast("long").alias("stop"), "strand", "gene_type", "anno_seed")


def wig_intervals(wig: DataFrame) -> DataFrame:
    return wig.select("chrom", F.col("pos").alias("begin"), (F.col("pos") + F.col("span") - 1).alias("stop"), "value")


def delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Write rows as delimited text."""
    df.write.option("sep", sep).option("quote", "").option("emptyValue", "").csv(path)


def bedgraph_text(precision: int = 4) -> Column:
    return F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.format_string(f"%.{precision}f", F.col("score").cast("double")))


def wig_text() -> Column:
    """variableStep lines, each with its declaration."""
    return F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.lit(" span="), F.col("span").cast("string"), F.lit("\n"), F.col("pos").cast("string"), F.lit(" "), F.col("value").cast("string"))

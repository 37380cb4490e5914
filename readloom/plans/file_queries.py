"""Queries of sources, sinks, the index, modes, streams and SQL functions: rows go out and come back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import register
from ..functions import sequence as S
from ..operators import adapter, disposition, kmers, overlap, profile, ranges, seeds
from ..sources import alignments, annotations
from ..sources import reads as io
from ..storage import work_dir
from ..streaming import trim
from . import modes
from .registry import query
from .views import ADAPTER1, ADAPTER2


def _written(lines: DataFrame, label: str) -> str:
    """Lines (a column ``value``) as text files of a new folder."""
    path = work_dir(lines.sparkSession, label)
    lines.write.text(path)
    return path


def _as_reads(reads: DataFrame, seq: str = "seq", qual: str = "qual", name: str = "name") -> DataFrame:
    return reads.select(F.col("read_id").alias("ordinal"), F.col(name).alias("name"), F.col(seq).alias("seq"), F.col(qual).alias("qual"))


_ORDERED = "SELECT row_number() OVER (ORDER BY read_id) - 1 AS ordinal, name, seq, qual FROM reads"


@query("reads", _ORDERED)
def fastq_records(reads):
    path = work_dir(reads.sparkSession, "fastq")
    io.write_reads(_as_reads(reads), path)
    return io.read_fastq(reads.sparkSession, path).select("ordinal", "name", "seq", "qual")


@query("reads", _ORDERED)
def fastq_gzip_records(reads):
    path = work_dir(reads.sparkSession, "fastq")
    io.write_reads(_as_reads(reads), path, gzip=True)
    return io.read_fastq(reads.sparkSession, path).select("ordinal", "name", "seq", "qual")


@query("reads", "SELECT name, seq, qual FROM reads")
def fastq_crlf_records(reads):
    """Lines end with a carriage return, and lower-case bases are folded."""
    text = F.concat(F.replace(F.concat_ws("\n", F.concat(F.lit("@"), "name"), F.lower("seq"), F.lit("+"), "qual"), F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    return io.read_fastq(reads.sparkSession, _written(reads.select(text.alias("value")), "crlf")).select("name", "seq", "qual")


@query("reads", "SELECT row_number() OVER (ORDER BY read_id) - 1 AS ordinal, name, seq FROM reads")
def fasta_records(reads):
    path = work_dir(reads.sparkSession, "fasta")
    io.write_reads(_as_reads(reads), path, fasta=True)
    return io.read_fasta(reads.sparkSession, path).select("ordinal", "name", "seq")


@query("contigs", "SELECT chrom, seq FROM contigs")
def fasta_multi_line_contigs(contigs):
    text = F.concat(F.lit(">"), "chrom", F.lit(" a description\n"), F.regexp_replace("seq", "(.{40})", "$1\n"))
    return io.read_contigs(contigs.sparkSession, _written(contigs.select(text.alias("value")), "contigs")).select("chrom", "seq")


@query("contigs", "SELECT chrom, CAST(c AS INT) AS chunk_no, c * 50 AS chunk_start, substring(seq, c * 50 + 1, 50) AS seq FROM contigs, (SELECT unnest(range(0, 3)) AS c) WHERE c * 50 < length(seq)")
def contig_chunks(contigs):
    return io.chunked(contigs, 50)


@query("reads", "SELECT CASE WHEN ascii(c) < 59 THEN 'sanger' ELSE 'solexa' END AS encoding FROM (SELECT regexp_extract(qual, '[^;-J]') AS c FROM reads WHERE regexp_matches(qual, '[^;-J]') ORDER BY read_id LIMIT 1)")
def quality_format(reads):
    return reads.sparkSession.createDataFrame([(io.quality_encoding(_as_reads(reads)),)], "encoding string")


@query("reads", "SELECT CAST(max(length(seq)) AS INT) AS longest FROM (SELECT seq FROM reads ORDER BY read_id LIMIT 100)")
def longest_of_first_reads(reads):
    """The first 100 reads are what this report is defined on."""
    return reads.sparkSession.createDataFrame([(io.longest_read(_as_reads(reads)),)], "longest int")


_ADAPTERS = [("first", ADAPTER1), ("second", ADAPTER2), ("long", ADAPTER1 + ADAPTER2)]


@query("reads", " UNION ALL ".join(f"SELECT {i} AS idx, '{n}' AS name, '{s[:64]}' AS seq" for i, (n, s) in enumerate(_ADAPTERS)))
def adapter_fasta(reads):
    spark = reads.sparkSession
    path = _written(spark.createDataFrame([("\n".join(f">{n}\n{s}" for n, s in _ADAPTERS),)], "value string"), "adapters")
    return spark.createDataFrame(io.read_adapters(spark, path), "idx int, name string, seq string")


@query("reads", "SELECT * FROM (VALUES ('a', 'x', true), ('a', 'y', false), ('b', 'x', false), ('b', 'y', true)) t(row_name, col_name, valid)")
def adapter_pair_matrix(reads):
    spark = reads.sparkSession
    path = _written(spark.createDataFrame([("%%comment\n%\tx\ty\na\t1\t0\nb\t0\t1",)], "value string"), "matrix")
    return io.read_pair_matrix(spark, path).select("row_name", "col_name", "valid")


@query("pairs", "SELECT row_number() OVER (ORDER BY pair_id) - 1 AS ordinal, r1, q1, r2, q2 FROM pairs")
def mates_from_files(pairs):
    spark, files = pairs.sparkSession, []
    for i in (1, 2):
        files.append(work_dir(spark, "mates"))
        io.write_reads(pairs.select(F.col("pair_id").alias("ordinal"), F.col("pair_id").cast("string").alias("name"), F.col(f"r{i}").alias("seq"), F.col(f"q{i}").alias("qual")), files[-1])
    return io.pair_up(*(io.read_fastq(spark, f) for f in files)).select("ordinal", "r1", "q1", "r2", "q2")


@query("reads", "SELECT CASE substring(seq, 1, 2) WHEN 'AC' THEN 'b1' WHEN 'GT' THEN 'b2' ELSE 'unassigned' END AS barcode, name, seq, qual FROM reads")
def demultiplexed_files(reads):
    spark, path = reads.sparkSession, work_dir(reads.sparkSession, "demux")
    rows = disposition.barcode(reads, [("b1", "AC"), ("b2", "GT")])
    io.write_reads(rows.select("barcode", *_as_reads(rows).columns[1:]), path, ordinal=None, partition_by="barcode")
    out = None
    for name in ("b1", "b2", "unassigned"):
        part = io.read_fastq(spark, f"{path}/barcode={name}").select(F.lit(name).alias("barcode"), "name", "seq", "qual") if rows.where(F.col("barcode") == name).limit(1).count() else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return out


@query("reads", "SELECT name, substring(seq, 1, 8) AS seq, substring(qual, 1, 8) AS qual FROM reads")
def barcode_reads(reads):
    return io.barcode_records(reads, 8).select("name", "seq", "qual")


@query("reads", "SELECT value FROM (VALUES ('#SampleID' || chr(9) || 'BarcodeSequence' || chr(9) || 'LinkerPrimerSequence' || chr(9) || 'Description'), ('s1' || chr(9) || 'AC' || chr(9) || chr(9) || 's1')) t(value)")
def sample_mapping(reads):
    return io.mapping_table(reads.sparkSession, [("s1", "AC")])


@query("reads pairs", """SELECT row_number() OVER (ORDER BY part, k) - 1 AS ordinal, seq FROM (SELECT 0 AS part, read_id AS k, seq FROM reads UNION ALL SELECT 1, pair_id, r1 FROM pairs)""")
def concatenated_reads(reads, pairs):
    first = ranges.indexed(reads.select("read_id", "seq"), "read_id").select("ordinal", "seq")
    second = ranges.indexed(pairs.select("pair_id", F.col("r1").alias("seq")), "pair_id").select("ordinal", "seq")
    return io.concatenated(first, second)


@query("reads", "SELECT read_id, translate(seq, 'ACGT', 'TGCA') AS seq FROM reads")
def head_adapter_reads(reads):
    return reads.select("read_id", S.head_adapter("seq").alias("seq"))


# -- alignments ------------------------------------------------------------------------------------------------

_SAM_LINE = """SELECT array_to_string([name, CASE WHEN read_id % 2 = 1 THEN '16' ELSE '0' END, concat('c', CAST(read_id % 5 AS STRING)), CAST(read_id % 9000 + 1 AS STRING), '60',
  '100M', '*', '0', '0', seq, qual, concat('NH:i:', CAST(read_id % 3 + 1 AS STRING))], chr(9)) AS line FROM reads"""


def _sam_rows(reads: DataFrame) -> DataFrame:
    tag = F.struct(F.lit("NH").alias("tag"), F.lit("i").alias("type"), (F.col("read_id") % 3 + 1).cast("string").alias("value"))
    return reads.select(
        F.col("name").alias("qname"), F.when(F.col("read_id") % 2 == 1, 16).otherwise(0).alias("flag"), F.concat(F.lit("c"), F.col("read_id") % 5).alias("rname"),
        (F.col("read_id") % 9000 + 1).cast("int").alias("pos"), F.lit(60).alias("mapq"), F.lit("100M").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"), "seq", "qual", F.array(tag).alias("tags"),
    )


@query("reads", _SAM_LINE)
def sam_records(reads):
    path = _written(_sam_rows(reads).select(alignments.sam_text().alias("value")), "sam")
    return alignments.read_sam(reads.sparkSession, path).select(alignments.sam_text().alias("line"))


@query("reads", f"SELECT replace(line, chr(9) || '0' || chr(9) || '0' || chr(9), chr(9) || '0' || chr(9) || '0' || chr(9)) AS line FROM ({_SAM_LINE})")
def bam_records(reads):
    """Each batch is encoded as a BAM file and decoded again."""
    rows = _sam_rows(reads)
    names = rows.columns

    def code(frames):
        for f in frames:
            records = f.to_dict("records")
            for r in records:
                r["tags"] = [dict(t) if not isinstance(t, dict) else t for t in r["tags"]]
            data = alignments.bam_bytes([(f"c{i}", 100_000) for i in range(5)], records)
            back = [r[:11] + ([dict(zip(("tag", "type", "value"), t)) for t in r[11]],) for r in alignments.parse_bam(alignments.inflate(data))]
            yield pd.DataFrame(back, columns=names)

    return rows.mapInPandas(code, rows.schema).select(alignments.sam_text().alias("line"))


@query("reads", "SELECT read_id FROM reads WHERE read_id % 5 = 3 AND read_id % 90000 < 61000 AND read_id % 90000 + 100 > 20000")
def binned_region(reads):
    """Alignments of c3 that overlap [20000, 61000): only the folders of bins that can hold them are read."""
    spark, path = reads.sparkSession, work_dir(reads.sparkSession, "binned")
    rows = reads.select("read_id", F.concat(F.lit("c"), F.col("read_id") % 5).alias("rname"), (F.col("read_id") % 90000).cast("int").alias("pos"), F.lit("100M").alias("cigar"))
    alignments.write_binned(rows, path)
    return alignments.read_binned(spark, path, "c3", 20000, 61000).select("read_id")


@query("reads", "SELECT read_id, CASE WHEN read_id % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN read_id % 2 = 1 THEN reverse(qual) ELSE qual END AS qual FROM reads")
def alignments_as_reads(reads):
    rows = _sam_rows(reads).withColumn("ordinal", F.regexp_extract("qname", "([0-9]+)$", 1).cast("long"))
    return alignments.reads_of(rows).select(F.col("ordinal").alias("read_id"), "seq", "qual")


@query("reads", """SELECT cycle, indel_len, count(*) AS n FROM (SELECT insert_len AS cycle, CAST(read_id % 9 + 1 AS INT) AS indel_len FROM reads
  UNION ALL SELECT CAST(insert_len + read_id % 9 + 1 AS INT), -2 FROM reads) GROUP BY 1, 2""")
def indel_profile(reads):
    text = F.concat(F.col("insert_len"), F.lit("M"), F.expr("read_id % 9 + 1"), F.lit("I2D"), F.expr("read_id % 5 + 1"), F.lit("S"))
    return profile.indels(reads.select(text.alias("cigar")))


# -- annotations -----------------------------------------------------------------------------------------------


@query("features", """SELECT chrom, CAST(begin + 1 AS INT) AS pos, 'v' || CAST(id AS STRING) AS id, 'ACG' AS ref, 'A' AS alt, CAST(id % 90 AS FLOAT) AS qual, 'PASS' AS filter,
  CAST(id % 7 AS STRING) AS dp FROM features""")
def vcf_records(features):
    return _vcf(features).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", F.col("info")["DP"].alias("dp"))


@query("features", "SELECT chrom, begin, begin + 2 AS stop, 'v' || CAST(id AS STRING) AS id FROM features")
def vcf_places(features):
    return annotations.vcf_intervals(_vcf(features)).select("chrom", "begin", "stop", "id")


def _vcf(features: DataFrame) -> DataFrame:
    spark = features.sparkSession
    body = features.select(F.concat_ws("\t", "chrom", F.col("begin") + 1, F.concat(F.lit("v"), "id"), F.lit("ACG"), F.lit("A"), F.col("id") % 90, F.lit("PASS"), F.concat(F.lit("DP="), F.col("id") % 7, F.lit(";DB"))).alias("value"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string")
    return annotations.read_vcf(spark, _written(head.unionByName(body), "vcf"))


@query("features", "SELECT chrom, begin, stop, gene_type, 'n' || CAST(id AS STRING) AS name FROM features")
def gff_records(features):
    spark = features.sparkSession
    body = features.select(F.concat_ws("\t", "chrom", F.lit("src"), "gene_type", F.col("begin") + 1, F.col("stop") + 1, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=n"), "id", F.lit(";X=y"))).alias("value"))
    rows = annotations.gff_intervals(annotations.read_gff(spark, _written(body, "gff")))
    return rows.select("chrom", "begin", "stop", "gene_type", annotations.gff_attributes()["ID"].alias("name"))


@query("features", "SELECT chrom, begin, stop, gene_type FROM features")
def bed_records(features):
    path = work_dir(features.sparkSession, "bed")
    annotations.delimited(features.select("chrom", F.col("begin") + 1, F.col("stop") + 1, F.lit("+"), "gene_type", F.lit("seed")), path)
    return annotations.bed_intervals(annotations.read_bed6(features.sparkSession, path)).select("chrom", "begin", "stop", "gene_type")


@query("features", "SELECT chrom, CAST(begin AS INT) AS start, CAST(stop AS INT) AS \"end\", CAST(id % 64 / 4.0 AS FLOAT) AS score FROM features")
def bedgraph_records(features):
    rows = features.select("chrom", F.col("begin").alias("start"), F.col("stop").alias("end"), (F.col("id") % 64 / 4.0).alias("score"))
    return annotations.read_bedgraph(features.sparkSession, _written(rows.select(annotations.bedgraph_text().alias("value")), "bedgraph"))


@query("features", """SELECT chrom, begin AS pos, CAST(5 AS INT) AS span, CAST(id % 64 AS DOUBLE) / 4 AS value, begin AS first, begin + 4 AS last FROM features
  UNION ALL SELECT chrom, begin + k * 10, 3, CAST(k AS DOUBLE), begin + k * 10, begin + k * 10 + 2 FROM features, (SELECT unnest(range(0, 3)) AS k)""")
def wig_records(features):
    """Each feature as a variableStep section of one place and a fixedStep section of three."""
    one = features.select("chrom", F.col("begin").alias("pos"), F.lit(5).alias("span"), (F.col("id") % 64 / 4.0).alias("value"), "begin")
    fixed = F.concat(F.lit("\nfixedStep chrom="), "chrom", F.lit(" start="), "begin", F.lit(" step=10 span=3\n0\n1\n2"))
    text = one.select(F.concat(F.lit("track type=wiggle_0\n"), annotations.wig_text(), fixed).alias("value"))
    rows = annotations.read_wig(features.sparkSession, _written(text, "wig"))
    return annotations.wig_intervals(rows).select("chrom", F.col("begin").alias("pos"), (F.col("stop") - F.col("begin") + 1).cast("int").alias("span"), "value", F.col("begin").alias("first"), F.col("stop").alias("last"))


# -- index and alignment ------------------------------------------------------------------------------------------


@query("contigs", "SELECT kmer, chrom, pos FROM (SELECT chrom, CAST(p AS BIGINT) AS pos, substring(seq, CAST(p AS INT) + 1, 20) AS kmer FROM (SELECT chrom, seq, unnest(range(0, length(seq) - 19)) AS p FROM contigs))")
def seed_table(contigs):
    """The k-mer table, saved and loaded."""
    path = work_dir(contigs.sparkSession, "index")
    return modes.build(contigs, 20, path).kmers.select("kmer", "chrom", "pos")


#: A read of each contig and strand: 60 bases of it, then its first 30 bases, which do not go on there.
_DRAWN = """n AS (SELECT chrom, seq, row_number() OVER (ORDER BY chrom) AS k FROM contigs),
d AS (SELECT * FROM (SELECT 2 * k AS read_id, 'p' || chrom AS name, concat(substring(seq, 11, 60), substring(seq, 1, 30)) AS seq FROM n
  UNION ALL SELECT 2 * k + 1, 'm' || chrom, concat(reverse(translate(substring(seq, 11, 60), 'ACGT', 'TGCA')), substring(seq, 1, 30)) FROM n)),
t AS (SELECT chrom, seq, CAST(pos AS BIGINT) AS pos, substring(seq, CAST(pos AS INT) + 1, 20) AS kmer FROM (SELECT chrom, seq, unnest(range(0, length(seq) - 19)) AS pos FROM contigs)),
h AS (SELECT read_id, d.name, d.seq, '+' AS strand, t.chrom, t.pos, substring(t.seq, CAST(t.pos AS INT) + 1, 90) AS ahead FROM d JOIN t ON substring(d.seq, 1, 20) = t.kmer
  UNION ALL SELECT read_id, d.name, d.seq, '-', t.chrom, t.pos, substring(reverse(translate(substring(t.seq, 1, CAST(t.pos AS INT) + 20), 'ACGT', 'TGCA')), 1, 90) FROM d JOIN t ON reverse(translate(substring(d.seq, 1, 20), 'ACGT', 'TGCA')) = t.kmer),
m AS (SELECT *, (SELECT coalesce(min(i) FILTER (substring(h.seq, i, 1) <> substring(ahead, i, 1)) - 1, least(length(h.seq), length(ahead))) FROM (SELECT CAST(unnest(range(1, 91)) AS INT) AS i) WHERE i <= length(ahead)) AS p FROM h),
a AS (SELECT read_id, name, seq, strand, chrom, CAST(p AS INT) AS p, CASE WHEN strand = '+' THEN pos ELSE pos + 20 - p END AS begin FROM (SELECT *, max(p) OVER (PARTITION BY read_id, strand) AS top FROM m) WHERE p = top),
l AS (SELECT *, count(*) OVER (PARTITION BY read_id, strand) AS n_loci, substring(seq, p + 1) AS tail FROM a)"""


def _drawn(contigs: DataFrame) -> DataFrame:
    made = ranges.indexed(contigs, "chrom", start=1)
    part, rest = F.substring("seq", 11, 60), F.substring("seq", 1, 30)
    one = made.select((2 * F.col("ordinal")).alias("read_id"), F.concat(F.lit("p"), "chrom").alias("name"), F.concat(part, rest).alias("seq"))
    two = made.select((2 * F.col("ordinal") + 1).alias("read_id"), F.concat(F.lit("m"), "chrom").alias("name"), F.concat(S.revcomp(part), rest).alias("seq"))
    return one.unionByName(two)


def _located(contigs: DataFrame) -> DataFrame:
    reads = _drawn(contigs)
    rows = seeds.seed_loci(reads, seeds.build_index(contigs, 20), allow_mismatch=False)
    return rows.join(reads.hint("merge"), "read_id").withColumn("qual", F.expr("repeat('I', length(seq))"))


@query("contigs", f"WITH {_DRAWN} SELECT read_id, strand, p AS prefix_len, tail, n_loci, chrom, begin AS pos FROM l")
def aligned_loci(contigs):
    """Reads of both strands drawn from the contigs, with every place of their longest exact prefix."""
    return _located(contigs).select("read_id", "strand", "prefix_len", "tail", "n_loci", "chrom", "pos")


@query("contigs", f"""WITH {_DRAWN} SELECT array_to_string([name, CASE WHEN strand = '-' THEN '16' ELSE '0' END, chrom, CAST(begin + 1 AS STRING), CAST(255 - length(tail) AS STRING),
  CASE WHEN tail = '' THEN concat(CAST(p AS STRING), 'M') WHEN strand = '-' THEN concat(CAST(length(tail) AS STRING), 'S', CAST(p AS STRING), 'M') ELSE concat(CAST(p AS STRING), 'M', CAST(length(tail) AS STRING), 'S') END,
  '*', '0', '0', CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, repeat('I', length(seq)),
  concat('NH:i:', CAST(n_loci AS STRING), CASE WHEN tail <> '' THEN concat(chr(9), 'TL:Z:', tail) ELSE '' END)], chr(9)) AS line FROM l""")
def aligned_sam_lines(contigs):
    """The aligner's own places as SAM."""
    return alignments.aligned_sam(_located(contigs)).select(alignments.sam_text().alias("line"))


@query("contigs", f"WITH {_DRAWN} SELECT chrom, begin, begin + p AS stop, strand, name, round(1.0 / n_loci, 6) AS reads FROM l")
def aligned_bed_rows(contigs):
    rows = alignments.to_bed(_located(contigs).withColumn("n", F.lit(1)))
    return rows.select("chrom", "begin", "stop", "strand", "name", F.round("reads", 6).alias("reads"))


@query("contigs", """WITH n AS (SELECT chrom, seq, row_number() OVER (ORDER BY chrom) AS k FROM contigs),
q AS (SELECT k AS read_id, concat(substring(seq, 21, k % 18), translate(substring(seq, 21 + k % 18, 1), 'ACGT', 'CGTA'), substring(seq, 22 + k % 18, 40)) AS s FROM n),
t AS (SELECT chrom, CAST(pos AS BIGINT) AS pos, substring(seq, CAST(pos AS INT) + 1, 18) AS kmer FROM (SELECT chrom, seq, unnest(range(0, length(seq) - 17)) AS pos FROM contigs)),
a AS (SELECT read_id, 0 AS half, substring(s, 1, 18) AS w, substring(s, 1, 9) AS h FROM q UNION ALL SELECT read_id, 1, substring(s, 1, 18), substring(s, 10, 9) FROM q),
b AS (SELECT chrom, pos, kmer, 0 AS half, substring(kmer, 1, 9) AS h FROM t UNION ALL SELECT chrom, pos, kmer, 1, substring(kmer, 10, 9) FROM t)
SELECT DISTINCT read_id, chrom, pos FROM a JOIN b USING (half, h) WHERE hamming(w, kmer) = 1""")
def seed_mismatch_places(contigs):
    """Reads drawn from the contigs with one base changed inside the seed."""
    made = ranges.indexed(contigs, "chrom", start=1).withColumn("at", (F.col("ordinal") % 18).cast("int"))
    seq = F.concat(F.expr("substring(seq, 21, at)"), F.translate(F.expr("substring(seq, 21 + at, 1)"), "ACGT", "CGTA"), F.expr("substring(seq, 22 + at, 40)"))
    return seeds.seed_mismatch(made.select(F.col("ordinal").alias("read_id"), seq.alias("seq")), seeds.build_index(contigs, 18))


@query("reads", """WITH x AS (SELECT read_id, k, substring(seq, CAST((read_id * k) % 3 * 30 AS INT) + 1) AS tail FROM reads, (SELECT unnest(range(1, 5)) AS k))
SELECT read_id, k, length(tail) AS tail_len FROM (SELECT *, rank() OVER (PARTITION BY read_id ORDER BY length(tail)) AS n FROM x) WHERE n = 1""")
def shortest_tail_set(reads):
    rows = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    rows = rows.select("read_id", F.col("k").cast("long").alias("k"), F.expr("substring(seq, int((read_id * k) % 3 * 30) + 1)").alias("tail"))
    return seeds.shortest_tail(rows).select("read_id", "k", F.length("tail").cast("long").alias("tail_len"))


# -- pairs, graphs, ranges ------------------------------------------------------------------------------------------


@query("pairs", "SELECT pair_id, substring(r1, 1, n) AS r1, substring(r2, 1, n) AS r2 FROM (SELECT pair_id, r1, substring(r2, 1, insert_len) AS r2, least(length(r1), insert_len) AS n FROM pairs)")
def mates_of_one_length(pairs):
    return overlap.cut_pair(pairs.select("pair_id", "r1", F.expr("substring(r2, 1, insert_len)").alias("r2"))).select("pair_id", "r1", "r2")


@query("pairs", """WITH b AS (SELECT pair_id, least(insert_len, 100) AS n, r1, q1, reverse(translate(substring(r2, 1, least(insert_len, 100)), 'ACGT', 'TGCA')) AS m, reverse(substring(q2, 1, least(insert_len, 100))) AS mq FROM pairs),
x AS (SELECT pair_id, least(ascii(substring(q1, i, 1)), ascii(substring(mq, i, 1))) - 33 AS q FROM b, (SELECT CAST(unnest(range(1, 101)) AS INT) AS i) WHERE i <= n AND substring(r1, i, 1) <> substring(m, i, 1))
SELECT pair_id, round((n * 2.477 - coalesce(c, 0)) / (n + 1), 6) AS score FROM b LEFT JOIN (SELECT pair_id, sum(CASE WHEN q <= 0 THEN 0.477 WHEN q > 39 THEN 4.477 ELSE 0.477 + q / 10.0 END) AS c FROM x GROUP BY 1) USING (pair_id)""")
def mate_scores(pairs):
    @F.pandas_udf("double")
    def score(r1: pd.Series, q1: pd.Series, r2: pd.Series, q2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([adapter.rc_score(*x) for x in zip(r1, q1, r2, q2, n)], dtype=float)

    return pairs.select("pair_id", F.round(score("r1", "q1", "r2", "q2", F.least("insert_len", F.lit(100))), 6).alias("score"))


@query("tails", """SELECT '  "' || src || '" -> "' || dst || '" [label=' || CAST(cnt AS STRING) || '];' AS line FROM (
  SELECT substring(tail, CAST(i AS INT), 10) AS src, substring(tail, CAST(i AS INT) + 1, 10) AS dst, count(*) AS cnt
  FROM (SELECT tail, unnest(range(1, length(tail) - 9)) AS i FROM tails WHERE length(tail) > 10) GROUP BY 1, 2) WHERE cnt >= 12""")
def graph_dot(tails):
    graph = kmers.Graph()
    graph.add((r["src"], r["dst"], r["cnt"]) for r in kmers.pruned(kmers.edges(tails, 10), 12).collect())
    lines = kmers.to_dot(graph.cut(1)).splitlines()[1:-1]
    return tails.sparkSession.createDataFrame([(t,) for t in lines], "line string")


@query("reads", "SELECT read_id FROM (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS k FROM reads) WHERE k % 17 = 0")
def reads_at(reads):
    """Every seventeenth read, gathered by its place."""
    rows = ranges.indexed(reads.select("read_id"), "read_id")
    wanted = ranges.irange(reads.sparkSession, 0, -(-rows.count() // 17)).select((F.col("value") * 17).alias("ordinal"))
    return ranges.at(rows, wanted).select("read_id")


@query("reads", """WITH t AS (SELECT insert_len AS x, count(*) AS y FROM reads GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY x) AS r FROM t),
p AS (SELECT a.r, a.x AS x0, b.x - a.x AS d, b.y, max(abs(b.x - a.x)) OVER (PARTITION BY a.r) AS far FROM r a JOIN r b ON b.r BETWEEN a.r - 7 AND a.r + 7),
w AS (SELECT *, pow(1 - pow(abs(d) / (far * 1.0001), 3), 3) AS w FROM p),
s AS (SELECT r, x0, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM w GROUP BY 1, 2)
SELECT x0 AS x, round(greatest(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 0), 4) AS smoothed FROM s""")
def smoothed_lengths(reads):
    table = reads.groupBy(F.col("insert_len").alias("x")).agg(F.count("*").alias("y"))
    return profile.loess(table, "x", "y", 7).select("x", F.round("smoothed", 4).alias("smoothed"))


# -- streams, SQL functions, modes -----------------------------------------------------------------------------------


@query("reads", "SELECT name, seq, qual FROM reads")
def streamed_reads(reads):
    """A folder of FASTQ files read as a stream into a table."""
    spark = reads.sparkSession
    folder, out, state = (work_dir(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    io.write_reads(_as_reads(reads), folder)
    trim.write_stream(trim.stream_fastq(spark, folder), out, state).awaitTermination()
    return spark.read.parquet(out).select("name", "seq", "qual")


@query("reads", """SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, CAST(hamming(seq, reverse(seq)) + len(string_split(seq, 'N')) - 1
  - (SELECT count(*) FILTER (substring(reads.seq, i, 1) = 'N' AND substring(reverse(reads.seq), i, 1) <> 'N') FROM (SELECT CAST(unnest(range(1, 101)) AS INT) AS i)) AS INT) AS d FROM reads""")
def sql_functions(reads):
    register.register(reads.sparkSession)
    return reads.selectExpr("read_id", "revcomp(seq) AS rc", "hamming(seq, reverse(seq)) AS d")


@query("tails", "SELECT kmer, count(*) AS cnt FROM (SELECT substring(tail, CAST(i AS INT), 12) AS kmer FROM (SELECT tail, unnest(range(1, length(tail) - 10)) AS i FROM tails WHERE length(tail) >= 12)) GROUP BY 1")
def sql_kmers(tails):
    register.register(tails.sparkSession)
    return tails.sparkSession.sql("SELECT k.kmer, count(*) AS cnt FROM {t} t, LATERAL kmers(t.tail, 12) k GROUP BY 1", t=tails)


@query("pairs")
def pairs_trimmed_separately(pairs):
    rows = modes.paired_separate(pairs, [ADAPTER1], [ADAPTER2])
    return rows.select("pair_id", "tag", "pos1", "pos2")


@query("reads contigs")
def single_trim(reads, contigs):
    """The single mode: an adapter detected from the tails of alignments, or the default one."""
    done = modes.single(reads.select("read_id", "name", "seq", "qual"), modes.build(contigs, 20))
    return done.reads.select("read_id", "tag", "pos")


@query("contigs")
def amplicon_reads(contigs):
    """A read between two primers of each contig, every second one from the other strand."""
    fwd, rev = "ACGTTGCAAGTCCTGA", "GGATCCTTAACCGTGT"
    text = F.concat(F.lit(fwd), "seq", S.revcomp(F.lit(rev)))
    rows = ranges.indexed(contigs, "chrom").withColumn("seq", F.when(F.col("ordinal") % 2 == 1, S.revcomp(text)).otherwise(text))
    rows = rows.select("chrom", "seq", F.expr("repeat('I', length(seq))").alias("qual"))
    return modes.amplicon(rows, [fwd], [rev])


@query("pairs")
def mate_pair_trim(pairs):
    """The first adapter as the junction of mate pairs."""
    return modes.mate_pair(pairs.select("pair_id", "r1", "q1", "r2", "q2"), ADAPTER1)

import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from readloom.sources import alignments, annotations, framing, reads


def fastq(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        m = r.randint(1, 70)
        qual = "".join(chr(r.randint(33, 126)) for _ in range(m))
        out.append((f"r{i} x", "".join(r.choice("ACGTN") for _ in range(m)), "@" + qual[1:]))
    return out, "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in out)


def test_fastq_over_small_splits(spark, write):
    rows, text = fastq(500)
    path = write("a.fq", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [tuple(r)[1:] for r in reads.read_fastq(spark, path).orderBy("ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows


def test_fastq_gzip_crlf_lower_case_and_two_files(spark, write):
    write("x/../a.fq.gz".replace("x/../", ""), gzip.compress(b"@a\r\nacgn\r\n+a\r\n@@@@\r\n"))
    path = write("b.fq", "@b\nAC\n+\n!!\n")
    folder = path.rsplit("/", 1)[0]
    got = reads.read_fastq(spark, [f"{folder}/a.fq.gz", path]).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(0, "a", "ACGN", "@@@@"), (1, "b", "AC", "!!")]


@pytest.mark.parametrize("text", ["a\nA\n+\n!\n", "@a\nA\n-\n!\n", "@a\nAC\n+\n!\n", "@a\nA\n+b\n!\n", "@a\nX\n+\n!\n", "@a\nA\n+\n"])
def test_invalid_fastq(spark, write, text):
    path = write("bad.fq", text)
    assert reads.read_fastq(spark, path, invalid="drop").count() == 0
    assert reads.read_fastq(spark, path, invalid="keep").first()["problem"]
    with pytest.raises(Exception, match="record 0"):
        reads.read_fastq(spark, path).collect()


def test_empty_fastq(spark, write):
    assert reads.read_fastq(spark, write("e.fq", "")).count() == 0


def test_fasta_multi_line(spark, write):
    path = write("a.fa", ">c1 first\nACGT\nac\n\n>c2\nNN\r\n>c3\n")
    got = [tuple(r)[:3] for r in reads.read_fasta(spark, path).orderBy("ordinal").collect()]
    assert got == [(0, "c1 first", "ACGTAC"), (1, "c2", "NN"), (2, "c3", "")]
    assert [r["chrom"] for r in reads.read_contigs(spark, path).orderBy("chrom_ord").collect()] == ["c1", "c2", "c3"]
    chunks = reads.chunked(reads.read_contigs(spark, path), 4).orderBy("chrom", "chunk_no").collect()
    assert [(r["chrom"], r["chunk_start"], r["seq"]) for r in chunks] == [("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 0, "NN"), ("c3", 0, "")]
    assert reads.read_adapters(spark, path)[0] == (0, "c1 first", "ACGTAC")


def test_pair_matrix_and_zip(spark, write):
    path = write("m.tsv", "%\ta\tb\nx\t1\t0\ny\t0\t1\n")
    got = {tuple(r) for r in reads.read_pair_matrix(spark, path).collect()}
    assert got == {("x", "a", True), ("x", "b", False), ("y", "a", False), ("y", "b", True)}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in.fq", "@a\nA\n+\n!\n")
    rows = reads.read_zip(spark, write("z.zip", data.getvalue()))
    assert [r["value"] for r in rows.orderBy("line").collect()] == ["@a", "A", "+", "!"]


def test_pairing_and_encoding(spark, write):
    a = reads.read_fastq(spark, write("1.fq", "@a\nAC\n+\n!!\n@b\nG\n+\nI\n"))
    b = reads.read_fastq(spark, write("2.fq", "@a\nTT\n+\n##\n@b\nC\n+\nI\n"))
    got = reads.pair_up(a, b).orderBy("ordinal").select("r1", "r2").collect()
    assert [tuple(r) for r in got] == [("AC", "TT"), ("G", "C")]
    with pytest.raises(ValueError):
        reads.pair_up(a, b.limit(1))
    assert reads.quality_encoding(a) == "sanger"
    assert reads.quality_encoding(a.withColumn("qual", F.lit("hhh"))) == "solexa"
    assert reads.quality_encoding(a.withColumn("qual", F.lit(None).cast("string"))) == "fasta"
    assert reads.longest_read(a) == 2


def test_write_reads_in_order(spark, write, tmp_path):
    rows, text = fastq(300)
    df = reads.read_fastq(spark, write("a.fq", text))
    out = str(tmp_path / "out")
    reads.write_reads(df.repartition(5), out, gzip=True)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert b"".join(gzip.decompress(p.read_bytes()) for p in parts).decode() == text
    reads.write_reads(df.withColumn("barcode", F.when(F.col("ordinal") < 10, "b1").otherwise("none")), str(tmp_path / "demux"), fasta=True, partition_by="barcode")
    assert reads.read_fasta(spark, str(tmp_path / "demux" / "barcode=b1")).count() == 10


def test_with_ordinal(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = framing.with_ordinal(df, "k")
    assert got.where("k <> ordinal").count() == 0 and got.count() == 1000


SAM = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100\na\t16\tc1\t5\t60\t3M1I2M2S\t*\t0\t0\tACGTACGT\tIIIIIIII\tNH:i:2\tMD:Z:a:b\nb\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t!!\n"


def test_sam_round_trip(spark, write):
    path = write("a.sam", SAM)
    df = alignments.read_sam(spark, path)
    text = [r[0] for r in df.orderBy("ordinal").select(alignments.sam_text()).collect()]
    assert text == SAM.splitlines()[2:]
    assert [r["kind"] for r in alignments.sam_header(spark, path).orderBy("line").collect()] == ["HD", "SQ"]
    assert df.orderBy("ordinal").first()["tags"][1]["value"] == "a:b"


def bam_records():
    tags = [{"tag": "NH", "type": "i", "value": "2"}, {"tag": "XA", "type": "A", "value": "q"}, {"tag": "MD", "type": "Z", "value": "7"}]
    base = {"rname": "c1", "mapq": 9, "rnext": "=", "pnext": 3, "tlen": -7, "tags": tags}
    return [
        base | {"qname": "a", "flag": 16, "pos": 4, "cigar": "3M2S", "seq": "ACGTN", "qual": "IIII!"},
        base | {"qname": "b", "flag": 0, "pos": 50, "cigar": "2M10N2M", "seq": "AACC", "qual": "ABCD", "tags": []},
        base | {"qname": "u", "flag": 4, "pos": -1, "cigar": "*", "seq": "ACG", "qual": "*", "rname": "*", "rnext": "*", "tags": []},
    ]


def test_bam_round_trip(spark, write):
    path = write("a.bam", alignments.bam_bytes([("c1", 100)], bam_records(), "@HD\tVN:1.6\n"))
    rows = alignments.read_bam(spark, path).orderBy("ordinal").collect()
    for got, want in zip(rows, bam_records()):
        for k, v in want.items():
            assert ([t.asDict() for t in got[k]] if k == "tags" else got[k]) == v, k
    assert alignments.read_bam(spark, path, ("c1", 60, 61)).count() == 1
    assert alignments.read_bam(spark, path, ("c1", 60, 61), end_by="qual").count() == 0
    seqs = alignments.reads_of(alignments.read_bam(spark, path)).orderBy("ordinal").collect()
    assert (seqs[0]["seq"], seqs[0]["qual"], seqs[1]["seq"]) == ("NACGT", "!IIII", "AACC")
    assert alignments.pairs_of(alignments.read_bam(spark, path)).count() == 1


def test_aligned_sam_and_bed(spark):
    rows = spark.createDataFrame(
        [("r", "ACGTT", "IIIII", "-", 3, "TT", [("c1", 4), ("c2", 9)], 6)],
        "name string, seq string, qual string, strand string, prefix_len int, tail string, loci array<struct<chrom:string,pos:int>>, n int",
    )
    text = [r[0] for r in alignments.aligned_sam(rows).select(alignments.sam_text()).collect()]
    assert text[0] == "r\t16\tc1\t5\t253\t2S3M\t*\t0\t0\tAACGT\tIIIII\tNH:i:2\tTL:Z:TT"
    assert [(r["begin"], r["stop"], r["reads"]) for r in alignments.to_bed(rows).collect()] == [(4, 7, 3.0), (9, 12, 3.0)]


def test_vcf(spark, write):
    path = write("a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc1\t10\t.\tACG\tA\t5.5\tPASS\tDP=3;DB\tGT:AD\t0/1:2\t1/1:3\nc1\t11\trs\tA\tT\t.\t.\t.\tGT\t0/0\t0/0\n")
    rows = annotations.read_vcf(spark, path).orderBy("pos").collect()
    assert rows[0]["info"] == {"DP": "3", "DB": None} and rows[0]["samples"] == {"s1": ["0/1", "2"], "s2": ["1/1", "3"]}
    assert rows[1]["qual"] is None and rows[1]["info"] == {}
    got = annotations.vcf_intervals(annotations.read_vcf(spark, path)).orderBy("begin").first()
    assert (got["begin"], got["stop"]) == (9, 11)
    assert annotations.vcf_header(spark, path).first()["key"] == "fileformat"
    text = annotations.read_vcf(spark, path).orderBy("pos").select(annotations.vcf_text()).first()[0]
    assert text == "c1\t10\t.\tACG\tA\t5.5\tPASS\tDP=3;DB"


def test_gff_bed_bedgraph_wig(spark, write):
    gff = annotations.read_gff(spark, write("a.gff", "##gff-version 3\nc1\tsrc\tgene\t5\t9\t.\t+\t.\tID=g;N=x\n##FASTA\n>c1\nACGT\n"))
    assert gff.count() == 1 and gff.select(annotations.gff_attributes().alias("a")).first()["a"]["N"] == "x"
    g = annotations.gff_intervals(gff).first()
    assert (g["begin"], g["stop"]) == (4, 8)
    bed = annotations.read_bed6(spark, write("a.bed", "c1\t5\t9\t+\tmiRNA\tseed\n"))
    b = annotations.bed_intervals(bed).first()
    assert (b["begin"], b["stop"], b["gene_type"]) == (4, 8, "miRNA")
    bg = annotations.read_bedgraph(spark, write("a.bg", "track type=bedGraph\nc1 1 5 2.5\n"))
    assert tuple(bg.first()) == ("c1", 1, 5, 2.5)
    assert bg.select(annotations.bedgraph_text(2)).first()[0] == "c1\t1\t5\t2.50"
    wig = annotations.read_wig(spark, write("a.wig", "track type=wiggle_0\nfixedStep chrom=c1 start=10 step=5 span=2\n1.5\n2\nvariableStep chrom=c2\n7 3\n"))
    assert sorted(map(tuple, wig.collect())) == [("c1", 10, 2, 1.5), ("c1", 15, 2, 2.0), ("c2", 7, 1, 3.0)]
    assert annotations.wig_intervals(wig).where("begin = 15").first()["stop"] == 16
    with pytest.raises(ValueError):
        annotations.read_wig(spark, write("b.wig", "fixedStep chrom=c1 start=1\n1\n"))


def test_binned_regions(spark, tmp_path):
    r = random.Random(4)
    rows = [("c%d" % r.randint(1, 2), r.randint(0, 300_000), f"{r.randint(20, 60)}M", i) for i in range(300)]
    df = spark.createDataFrame(rows, "rname string, pos int, cigar string, ordinal long")
    path = str(tmp_path / "binned")
    alignments.write_binned(df, path)
    for begin, end in ((0, 10), (16_380, 16_390), (100_000, 180_000)):
        want = sorted(i for c, p, g, i in rows if c == "c1" and p < end and p + int(g[:-1]) > begin)
        got = alignments.read_binned(spark, path, "c1", begin, end)
        assert sorted(x["ordinal"] for x in got.collect()) == want
        assert "PartitionFilters: [isnotnull(rname" in got._jdf.queryExecution().executedPlan().toString()

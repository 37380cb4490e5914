"""The library's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import adapter, disposition, evaluate, intervals, kmers, overlap, profile, ranges, seeds, simulate
from ..sources import alignments
from ..sources import reads as io
from . import modes
from .registry import query
from .views import ADAPTER1, ADAPTER2

big = lambda c: F.col(c).cast("long").alias(c)


# -- scalar functions and projections -------------------------------------------------------------


@query("reads", "SELECT read_id, reverse(translate(seq, 'ACGTacgt', 'TGCATGCA')) AS rc FROM reads")
def revcomp_reads(reads):
    return reads.select("read_id", S.revcomp("seq").alias("rc"))


@query("contigs", """SELECT chrom, reverse(translate(concat(seq, 'MRWSYKVHDBN'),
  'ACGTUMRWSYKVHDBNacgtumrwsykvhdbn', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn')) AS rc FROM contigs""")
def iupac_revcomp(contigs):
    return contigs.select("chrom", S.iupac_revcomp(F.concat("seq", F.lit("MRWSYKVHDBN"))).alias("rc"))


@query("reads", """SELECT read_id, round(CASE WHEN length(replace(seq, 'N', '')) > 0
  THEN 100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(replace(seq, 'N', '')) END, 6) AS gc FROM reads""")
def gc_percent(reads):
    return reads.select("read_id", F.round(S.gc_percent("seq"), 6).alias("gc"))


@query("reads", "SELECT read_id, length(regexp_replace(qual, '[!-4]+$', '')) AS kept FROM reads")
def quality_trim3(reads):
    return reads.select("read_id", big_len(S.quality_trim3("qual", 20)))


def big_len(c):
    return c.cast("long").alias("kept")


@query("reads", """SELECT read_id, round(m, 6) AS mean_q FROM (
  SELECT read_id, list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) / length(qual) AS m FROM reads) WHERE m >= 20""")
def mean_quality_filter(reads):
    return reads.where(S.quality_passes("qual", 20)).select("read_id", F.round(S.mean_quality("qual"), 6).alias("mean_q"))


@query("reads", "SELECT read_id FROM reads WHERE length(regexp_replace(seq, '[ACGTUacgtu]', '', 'g')) <= ceil(0.1 * length(seq))")
def blurry_filter(reads):
    return reads.where(~S.is_blurry("seq", 0.1)).select("read_id")


@query("reads", """SELECT read_id, greatest(length(regexp_replace(h, '[^A]', '', 'g')), length(regexp_replace(h, '[^C]', '', 'g')),
  length(regexp_replace(h, '[^G]', '', 'g')), length(regexp_replace(h, '[^T]', '', 'g'))) >= 40 AS low
  FROM (SELECT read_id, seq AS h FROM reads)""")
def low_complexity(reads):
    return reads.select("read_id", S.low_complexity("seq", 100, 0.4).alias("low"))


@query("reads", "SELECT read_id, concat(substring(seq, 1, insert_len), lower(substring(seq, insert_len + 1))) AS seq FROM reads WHERE insert_len < 100")
def masked_output(reads):
    return reads.where("insert_len < 100").select("read_id", S.masked("seq", "insert_len").alias("seq"))


@query("reads", """SELECT read_id, rpad(substring(seq, 1, insert_len), 100, 'N') AS seq, rpad(substring(qual, 1, insert_len), 100, '!') AS qual
  FROM reads WHERE insert_len < 100""")
def n_filled_output(reads):
    return reads.where("insert_len < 100").select("read_id", S.n_filled("seq", "insert_len").alias("seq"), S.quality_filled("qual", "insert_len").alias("qual"))


@query("pairs", "SELECT pair_id, CAST(hamming(r1, reverse(translate(r2, 'ACGT', 'TGCA'))) AS BIGINT) AS d FROM pairs")
def hamming_distance(pairs):
    return pairs.select("pair_id", S.hamming("r1", S.revcomp("r2")).cast("long").alias("d"))


@query("reads", """SELECT read_id, round(sum(CASE WHEN q <= 0 THEN 0.477 WHEN q > 39 THEN 4.477 ELSE 0.477 + q / 10.0 END), 6) AS cost,
  round(sum(pow(10.0, -q / 10.0)), 6) AS errors
  FROM (SELECT read_id, ascii(unnest(string_split(qual, ''))) - 33 AS q FROM reads) GROUP BY read_id""")
def quality_costs(reads):
    q = F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33)
    total = lambda f: F.round(F.aggregate(F.transform(q, f), F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return reads.select("read_id", total(S.penalty).alias("cost"), total(S.error_rate).alias("errors"))


@query("features", """SELECT id, CAST(CASE WHEN begin >> 14 = (stop - 1) >> 14 THEN (begin >> 14) + 4681 WHEN begin >> 17 = (stop - 1) >> 17 THEN (begin >> 17) + 585
  WHEN begin >> 20 = (stop - 1) >> 20 THEN (begin >> 20) + 73 WHEN begin >> 23 = (stop - 1) >> 23 THEN (begin >> 23) + 9
  WHEN begin >> 26 = (stop - 1) >> 26 THEN (begin >> 26) + 1 ELSE 0 END AS INT) AS bin, len(range(begin >> 14, ((stop - 1) >> 14) + 1)) + 5 AS n_bins FROM features""")
def reg2bin(features):
    return features.select("id", S.reg2bin("begin", "stop").alias("bin"), F.size(S.reg2bins("begin", "stop")).cast("long").alias("n_bins"))


@query("reads", """SELECT read_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(translate(substring(replace(seq, 'N', 'A'), 1, 20), 'ACGT', '0123'), ''),
  lambda c: CAST(c AS BIGINT))), lambda s, x: s * 4 + x) AS code, substring(replace(seq, 'N', 'A'), 1, 20) AS kmer FROM reads""")
def kmer_packing(reads):
    code = S.pack_kmer(F.substring(F.replace("seq", F.lit("N"), F.lit("A")), 1, 20))
    return reads.select("read_id", code.alias("code")).select("read_id", "code", S.unpack_kmer("code", 20).alias("kmer"))


@query("reads", """WITH p AS (SELECT read_id, unnest(range(1, 101)) AS i, string_split(seq, '') AS s FROM reads),
n AS (SELECT read_id, i, i - row_number() OVER (PARTITION BY read_id ORDER BY i) AS g FROM p WHERE s[i] = 'N')
SELECT read_id, min(i) - 1 AS start, count(*) AS len FROM n GROUP BY read_id, g""")
def n_run_table(reads):
    rows = reads.select("read_id", F.explode(S.n_runs("seq")).alias("r"))
    return rows.select("read_id", F.col("r.start").cast("long").alias("start"), F.col("r.len").cast("long").alias("len"))


@query("reads", """SELECT read_id, concat(CAST(insert_len AS STRING), 'M', CAST(read_id % 9 + 1 AS STRING), 'I2D', CAST(read_id % 5 + 1 AS STRING), 'S') AS cigar,
  CAST(insert_len + 2 AS BIGINT) AS ref_len, CAST(insert_len + read_id % 9 + 1 + read_id % 5 + 1 AS BIGINT) AS query_len FROM reads""")
def cigar_lengths(reads):
    text = F.concat(F.col("insert_len"), F.lit("M"), F.expr("read_id % 9 + 1"), F.lit("I2D"), F.expr("read_id % 5 + 1"), F.lit("S"))
    ops = reads.select("read_id", S.cigar_ops(text).alias("ops"))
    return ops.select("read_id", S.cigar_text("ops").alias("cigar"), S.reference_length("ops").cast("long").alias("ref_len"), S.query_length("ops").cast("long").alias("query_len"))


@query("reads", """SELECT f AS flags, count(*) AS n, count(*) FILTER (f & 16 <> 0) AS n_reverse, count(*) FILTER (f & 4 <> 0) AS n_unmapped
  FROM (SELECT read_id % 32 AS f FROM reads) GROUP BY f""")
def flag_counts(reads):
    rows = reads.select((F.col("read_id") % 32).alias("flags"))
    return rows.groupBy("flags").agg(F.count("*").alias("n"), F.count_if(S.flag("flags", "reverse")).alias("n_reverse"), F.count_if(S.flag("flags", "unmapped")).alias("n_unmapped"))


@query("reads", "SELECT regexp_extract(name, '^[^ /]*') AS key, CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS number FROM reads")
def name_keys(reads):
    return reads.select(S.name_key(F.concat("name", F.lit("/1"))).alias("key"), S.read_number(F.concat("name", F.lit("/1"))).alias("number"))


# -- reads: filters, dispositions, summaries -------------------------------------------------------


@query("reads", "SELECT length(substring(seq, 1, insert_len)) AS len, count(*) AS n FROM reads WHERE insert_len >= 18 GROUP BY 1")
def read_length_hist(reads):
    kept = reads.where("insert_len >= 18").select(S.revcomp(F.expr("substring(seq, 1, insert_len)")).alias("seq"))
    return disposition.length_histogram(kept, F.length("seq").cast("long"))


_DISPOSED = """d AS (SELECT *, length(regexp_replace(substring(qual, 1, least(insert_len, 100)), '[!-4]+$', '')) AS pos FROM reads),
t AS (SELECT *, CASE WHEN length(regexp_replace(seq, '[ACGTUacgtu]', '', 'g')) > ceil(0.1 * length(seq)) THEN 'BLURRY'
  WHEN list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) < 18 * length(qual) THEN 'BADQUAL'
  WHEN pos <= 0 THEN 'EMPTY' WHEN pos < 30 THEN 'SHORT' WHEN pos > 95 THEN 'LONG' ELSE 'NORMAL' END AS tag FROM d)"""


def _disposed(reads):
    return disposition.dispose(reads, "insert_len", min_len=30, max_len=95, drop_blurry=True, mean_quality=18, end_quality=20)


@query("reads", f"SELECT tag, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (WITH {_DISPOSED} SELECT tag, count(*) AS n FROM t GROUP BY tag)")
def disposition_counts(reads):
    return disposition.summary(_disposed(reads)).withColumn("percent", F.round("percent", 6))


@query("reads", f"WITH {_DISPOSED} SELECT read_id, substring(seq, 1, pos) AS seq, substring(qual, 1, pos) AS qual FROM t WHERE tag = 'NORMAL'")
def trimmed_reads(reads):
    return disposition.trimmed(_disposed(reads)).select("read_id", "seq", "qual")


@query("reads", f"WITH {_DISPOSED} SELECT concat(name, ' ', tag) AS name, seq FROM t WHERE tag <> 'NORMAL'")
def excluded_reads(reads):
    return disposition.excluded(_disposed(reads)).select("name", "seq")


@query("reads", f"""WITH {_DISPOSED} SELECT count(*) AS n, count(*) FILTER (tag <> 'NORMAL' OR pos < length(seq)) AS n_trimmed,
  round(100.0 * count(*) FILTER (tag <> 'NORMAL' OR pos < length(seq)) / count(*), 6) AS percent FROM t""")
def trimmed_percent(reads):
    return disposition.trimmed_percent(_disposed(reads)).withColumn("percent", F.round("percent", 6))


@query("reads", """SELECT CASE substring(seq, 1, 2) WHEN 'AC' THEN 'b1' WHEN 'GT' THEN 'b2' WHEN 'CA' THEN 'b3' ELSE 'unassigned' END AS barcode, count(*) AS n
  FROM reads GROUP BY 1""")
def barcode_demux_counts(reads):
    return disposition.barcode(reads, [("b1", "AC"), ("b2", "GT"), ("b3", "CA")]).groupBy("barcode").agg(F.count("*").alias("n"))


@query("reads pairs", "SELECT seq, count(*) AS n FROM (SELECT seq FROM reads UNION ALL SELECT seq FROM reads UNION ALL SELECT r1 FROM pairs) GROUP BY 1")
def collapse_reads(reads, pairs):
    """Whole sequences; the reads are there twice, so that most have copies."""
    return disposition.collapse(reads.select("seq").unionByName(reads.select("seq")).unionByName(pairs.select(F.col("r1").alias("seq"))))


@query("reads", """SELECT s AS seed_len, round(p, 6) AS percent FROM (SELECT s, 100.0 * count(*) FILTER (insert_len <= s * 4) / count(*) AS p
  FROM reads, (SELECT unnest(range(15, 21)) AS s) GROUP BY s) ORDER BY p DESC, s DESC LIMIT 1""")
def smallrna_best_seed(reads):
    runs = reads.select(F.explode(F.sequence(F.lit(15), F.lit(20))).alias("seed_len"), "insert_len")
    runs = runs.groupBy("seed_len").agg((100.0 * F.count_if(F.col("insert_len") <= F.col("seed_len") * 4) / F.count("*")).alias("percent"))
    return disposition.best_seed(runs).select(big("seed_len"), F.round("percent", 6).alias("percent"))


# -- k-mers and assembly -----------------------------------------------------------------------------


_KMERS = "SELECT frag_id, i, substring(tail, CAST(i AS INT), 10) AS kmer FROM (SELECT frag_id, tail, unnest(range(1, length(tail) - 8)) AS i FROM tails WHERE length(tail) >= 10)"
_EDGES = """SELECT substring(tail, CAST(i AS INT), 10) AS src, substring(tail, CAST(i AS INT) + 1, 10) AS dst, count(*) AS cnt
  FROM (SELECT tail, unnest(range(1, length(tail) - 9)) AS i FROM tails WHERE length(tail) > 10) GROUP BY 1, 2"""


def _graph(tails):
    return kmers.pruned(kmers.edges(tails, 10), 12)


@query("tails", f"SELECT kmer, count(*) AS cnt FROM ({_KMERS}) GROUP BY kmer")
def kmer_counts(tails):
    return kmers.kmer_counts(tails, 10)


@query("tails", f"SELECT DISTINCT kmer FROM (SELECT frag_id, kmer FROM ({_KMERS}) GROUP BY 1, 2 HAVING count(*) > 1)")
def dup_kmers(tails):
    return kmers.dup_kmers(tails, 10)


@query("tails", f"SELECT * FROM ({_EDGES}) WHERE cnt >= 12")
def edge_support_pruned(tails):
    return _graph(tails)


@query("tails", f"WITH e AS (SELECT * FROM ({_EDGES}) WHERE cnt >= 12) SELECT DISTINCT src AS kmer FROM e WHERE src NOT IN (SELECT dst FROM e)")
def graph_sources(tails):
    return kmers.sources(_graph(tails))


@query("tails", f"WITH e AS (SELECT * FROM ({_EDGES}) WHERE cnt >= 12) SELECT DISTINCT dst AS kmer FROM e WHERE dst NOT IN (SELECT src FROM e)")
def graph_sinks(tails):
    return kmers.sinks(_graph(tails))


@query("tails", f"""SELECT o AS "offset", count(*) AS cnt FROM (SELECT instr(concat(repeat('C', CAST(frag_id % 4 AS INT)), tail), '{ADAPTER1[:5]}') - 1 AS o FROM tails)
  WHERE o >= 0 GROUP BY o ORDER BY cnt DESC, o LIMIT 1""")
def umi_offset_mode(tails):
    shifted = tails.select("frag_id", F.concat(F.expr("repeat('C', int(frag_id % 4))"), "tail").alias("tail"))
    return kmers.umi_offsets(shifted, ADAPTER1).orderBy(F.desc("cnt"), "offset").limit(1).select(big("offset"), "cnt")


# -- pairs ----------------------------------------------------------------------------------------------


@query("pairs", """SELECT a.ordinal, a.r1, b.r2 FROM (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS ordinal, pair_id, r1 FROM pairs) a
  JOIN (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS ordinal, r2 FROM pairs) b USING (ordinal)""")
def pair_by_ordinal(pairs):
    from ..sources.framing import with_ordinal

    a = with_ordinal(pairs.select("pair_id", "r1"), "pair_id").select("ordinal", "r1")
    b = with_ordinal(pairs.select("pair_id", "r2"), "pair_id").select("ordinal", "r2")
    return a.join(b, "ordinal").select("ordinal", "r1", "r2")


_INSERT = """SELECT pair_id, coalesce(max(i), 100) AS pos FROM (
  SELECT p.pair_id, i FROM pairs p, (SELECT CAST(unnest(range(16, 101)) AS INT) AS i)
  WHERE (16 - hamming(substring(r1, i - 15, 16), reverse(translate(substring(r2, 1, 16), 'ACGT', 'TGCA')))) * 10 >= 16 * 7
    AND (16 - hamming(substring(r2, i - 15, 16), reverse(translate(substring(r1, 1, 16), 'ACGT', 'TGCA')))) * 10 >= 16 * 7
    AND (i - hamming(substring(r1, 1, i), reverse(translate(substring(r2, 1, i), 'ACGT', 'TGCA')))) * 10 >= i * 9) x
  RIGHT JOIN (SELECT pair_id FROM pairs) q USING (pair_id) GROUP BY pair_id"""


@query("pairs", _INSERT)
def mate_overlap_insert_len(pairs):
    return pairs.select("pair_id", overlap.insert_len("r1", "r2").alias("pos"))


@query("pairs", f"""WITH w AS (SELECT p.pair_id, r1, r2, i FROM pairs p, (SELECT CAST(unnest(range(16, 101)) AS INT) AS i)
  WHERE (16 - hamming(substring(r1, i - 15, 16), reverse(translate(substring(r2, 1, 16), 'ACGT', 'TGCA')))) * 10 >= 16 * 7
    AND (16 - hamming(substring(r2, i - 15, 16), reverse(translate(substring(r1, 1, 16), 'ACGT', 'TGCA')))) * 10 >= 16 * 7),
x AS (SELECT pair_id, i FROM w WHERE i < 100
    AND (i - hamming(substring(r1, 1, i), reverse(translate(substring(r2, 1, i), 'ACGT', 'TGCA')))) * 10 >= i * 9
    AND CASE WHEN i < 100 THEN (least(34, 100 - i) - hamming(substring(r1, i + 1, least(34, 100 - i)), substring('{ADAPTER1}', 1, least(34, 100 - i)))) * 10 >= least(34, 100 - i) * 8
      OR (least(34, 100 - i) - hamming(substring(r2, i + 1, least(34, 100 - i)), substring('{ADAPTER2}', 1, least(34, 100 - i)))) * 10 >= least(34, 100 - i) * 8 END),
h AS (SELECT pair_id, coalesce(min(o) FILTER ((16 - hamming(substring(r1, o + 1, 16), substring('{ADAPTER1}', 1, 16))) * 10 > 16 * 8),
        min(o) FILTER ((16 - hamming(substring(r2, o + 1, 16), substring('{ADAPTER2}', 1, 16))) * 10 > 16 * 8)) AS o
      FROM (SELECT * FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM w)), (SELECT CAST(unnest(range(0, 16)) AS INT) AS o) GROUP BY pair_id),
b AS (SELECT pair_id, r1, r2, coalesce(m, o, 100) AS pos FROM pairs LEFT JOIN (SELECT pair_id, max(i) AS m FROM x GROUP BY pair_id) USING (pair_id) LEFT JOIN h USING (pair_id))
SELECT pair_id, substring(r1, 1, pos) AS r1, substring(r2, 1, pos) AS r2 FROM b WHERE pos >= 45""")
def pe_trim(pairs):
    return overlap.trim_pairs(pairs, (ADAPTER1, ADAPTER2), 45).select("pair_id", "r1", "r2")


@query("pairs", """SELECT pair_id, array_to_string(list_transform(range(1, 101), lambda i: CASE WHEN ascii(q2[101 - i]) > ascii(q1[i]) THEN translate(r2[101 - i], 'ACGT', 'TGCA') ELSE r1[i] END), '') AS seq,
  array_to_string(list_transform(range(1, 101), lambda i: CASE WHEN ascii(q2[101 - i]) > ascii(q1[i]) THEN q2[101 - i] ELSE q1[i] END), '') AS qual FROM pairs""")
def mate_consensus(pairs):
    c = overlap.consensus("r1", "q1", "r2", "q2")
    return pairs.select("pair_id", c.alias("c")).select("pair_id", "c.seq", "c.qual")


_SCORED = f"""o AS (SELECT pair_id, CASE WHEN pos >= 60 THEN pos END AS out_len FROM ({_INSERT}) z),
s AS (SELECT least(insert_len, 100) AS truth_len, out_len FROM pairs JOIN o USING (pair_id)),
c AS (SELECT *, CASE WHEN out_len IS NULL THEN CASE WHEN truth_len = 0 THEN 'TP' ELSE 'FP' END WHEN out_len = truth_len AND out_len = 100 THEN 'TN'
  WHEN out_len = truth_len THEN 'TP' WHEN out_len > truth_len THEN 'FN' ELSE 'FP' END AS k FROM s)"""


def _scored(pairs):
    truth = pairs.select(F.col("pair_id").alias("name"), F.least("insert_len", F.lit(100)).alias("len"))
    out = pairs.select(F.col("pair_id").alias("name"), overlap.insert_len("r1", "r2").alias("len")).where("len >= 60")
    return evaluate.outcomes(out, truth, 100)


@query("pairs", f"WITH {_SCORED} SELECT count(*) FILTER (k = 'TP') AS tp, count(*) FILTER (k = 'TN') AS tn, count(*) FILTER (k = 'FP') AS fp, count(*) FILTER (k = 'FN') AS fn FROM c")
def trim_confusion(pairs):
    return evaluate.confusion(_scored(pairs))


@query("pairs", f"""WITH {_SCORED}, n AS (SELECT greatest(count(*) FILTER (k = 'TP'), 1)::DOUBLE AS tp, greatest(count(*) FILTER (k = 'TN'), 1)::DOUBLE AS tn,
  greatest(count(*) FILTER (k = 'FP'), 1)::DOUBLE AS fp, greatest(count(*) FILTER (k = 'FN'), 1)::DOUBLE AS fn FROM c)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS acc, round(tp / (tp + fn), 6) AS sen, round(tn / (tn + fp), 6) AS spc, round(tp / (tp + fp), 6) AS ppv,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM n""")
def trim_metrics(pairs):
    m = evaluate.metrics(evaluate.confusion(_scored(pairs)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("pairs", f"WITH {_SCORED} SELECT CAST(sum(greatest(coalesce(out_len, 0) - truth_len, 0)) AS BIGINT) AS under_trimmed, CAST(sum(greatest(truth_len - coalesce(out_len, 0), 0)) AS BIGINT) AS over_trimmed FROM c")
def overtrim_bases(pairs):
    return evaluate.trim_errors(_scored(pairs))


# -- intervals --------------------------------------------------------------------------------------------


_HIT = "q.chrom = d.chrom AND q.begin <= d.stop AND q.stop >= d.begin"


@query("queries features", f"SELECT q.id, d.id AS db_id FROM queries q JOIN features d ON {_HIT}")
def interval_overlap(queries, features):
    return intervals.overlap_join(queries, features).select("id", "db_id")


@query("queries features", f"SELECT q.id, array_to_string(list_sort(array_agg(d.id) FILTER (d.id IS NOT NULL)), ',') AS hits FROM queries q LEFT JOIN features d ON {_HIT} GROUP BY q.id")
def interval_overlap_outer_lists(queries, features):
    rows = intervals.overlap_lists(queries.select("id", "chrom", "begin", "stop"), features, sep=",")
    return rows.select("id", F.when(F.col("hits") != "", F.col("hits")).alias("hits"))


@query("queries features", f"""WITH h AS (SELECT q.id, q.begin AS qb, q.stop AS qs, d.begin AS db, d.stop AS ds FROM queries q JOIN features d ON {_HIT}),
p AS (SELECT id, begin AS pos FROM queries UNION SELECT id, stop FROM queries UNION SELECT id, greatest(qb, db) FROM h UNION SELECT id, least(qs, ds) FROM h),
r AS (SELECT id, pos AS begin, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS stop FROM p)
SELECT r.id, q.chrom, r.begin, r.stop, (SELECT count(*) FROM h WHERE h.id = r.id AND h.db <= r.begin AND h.ds > r.begin) AS depth
FROM r JOIN queries q USING (id) WHERE r.stop > r.begin""")
def coverage_runs(queries, features):
    return intervals.coverage(queries, features)


@query("queries features", f"""WITH h AS (SELECT q.id, array_agg(d.gene_type) AS t FROM queries q JOIN features d ON {_HIT} GROUP BY q.id)
SELECT gene_type, round(sum(p), 6) AS reads FROM (SELECT unnest(t) AS gene_type, (id % 10 + 1) / len(t) AS p FROM h) GROUP BY 1""")
def anno_fractional_counts(queries, features):
    rows = intervals.fractional_counts(queries.withColumn("reads", F.col("id") % 10 + 1), features)
    return rows.select("gene_type", F.round("reads", 6).alias("reads"))


@query("queries features", f"""WITH h AS (SELECT q.id, count(*) AS n FROM queries q JOIN features d ON {_HIT} GROUP BY q.id)
SELECT d.gene_type, round(sum((q.id % 10 + 1) / h.n), 6) AS reads FROM queries q JOIN features d ON {_HIT} JOIN h ON h.id = q.id GROUP BY 1""")
def anno_fractional_counts_of_pairs(queries, features):
    """The same shares from pairs and counts, without a list for each query."""
    rows = intervals.fractional_counts(queries.withColumn("reads", F.col("id") % 10 + 1), features)
    return rows.select("gene_type", F.round("reads", 6).alias("reads"))


@query("queries", "SELECT chrom, n, round(n * 1e6 / sum(n) OVER (), 6) AS ppm FROM (SELECT chrom, count(*) AS n FROM queries GROUP BY chrom)")
def ppm(queries):
    return intervals.with_ppm(queries.groupBy("chrom").agg(F.count("*").alias("n")), "n").withColumn("ppm", F.round("ppm", 6))


@query("queries features", f"""WITH h AS (SELECT q.id, max(CAST(d.gene_type IN ('type1', 'type3') AS INT)) AS f FROM queries q LEFT JOIN features d ON {_HIT} GROUP BY q.id)
SELECT id, coalesce(f, 0) = 1 AS is_filtered FROM h""")
def annotation_filter(queries, features):
    return intervals.filtered(queries, features, ("type1", "type3")).select("id", "is_filtered")


@query("queries features", f"""SELECT source, count(*) AS n FROM (SELECT 'a' AS source, chrom, begin, stop FROM features UNION ALL SELECT 'b', chrom, begin, stop FROM queries) d
  JOIN queries q ON {_HIT} GROUP BY source""")
def multi_source_overlap(queries, features):
    both = intervals.union_databases(a=features, b=queries)
    return intervals.overlap_sums(both, queries).where("hits > 0").groupBy("source").agg(F.sum("hits").alias("n"))

# -- adapters -----------------------------------------------------------------------------------------


@query("reads", f"""WITH h AS (SELECT read_id, i, hamming(substring(seq, i + 1, least(34, 100 - i)), substring('{ADAPTER1}', 1, least(34, 100 - i))) AS d,
  least(34, 100 - i) AS m FROM reads, (SELECT CAST(unnest(range(0, 98)) AS INT) AS i)),
c AS (SELECT read_id, i, m, (m * 2.477 - d * 2.477) / (m + 1) AS s, d FROM h WHERE d * 2.477 < 0.1 * 2.477 * m + 0.001),
f AS (SELECT read_id, min(d) AS best FROM c WHERE m = 34 GROUP BY read_id),
p AS (SELECT c.* FROM c LEFT JOIN f USING (read_id) WHERE m < 34 OR d = best)
SELECT read_id, CAST(coalesce(arg_max(i, s * 1e6 + m * 1e-3 + i * 1e-6), 100) AS INT) AS pos FROM (SELECT read_id FROM reads) r
LEFT JOIN p USING (read_id) GROUP BY read_id""")
def best_adapter_hamming(reads):
    return reads.select("read_id", adapter.adapter_pos("seq", None, [ADAPTER1], delta=0.0).alias("a")).select("read_id", "a.pos")


@query("contigs", """WITH p AS (SELECT chrom, seq, CAST(unnest(range(0, 109)) AS INT) AS pos FROM contigs),
t AS (SELECT substring(seq, pos + 1, 20) AS kmer, chrom, pos, substring(seq, pos + 1, 256) AS ahead FROM p),
q AS (SELECT read_id, seq FROM (SELECT c.chrom, CAST(row_number() OVER (ORDER BY c.chrom) AS BIGINT) AS read_id, concat(substring(c.seq, 11, 60), substring(c.seq, 1, 30)) AS seq FROM contigs c)),
h AS (SELECT q.read_id, q.seq, t.ahead FROM q JOIN t ON substring(q.seq, 1, 20) = t.kmer),
m AS (SELECT read_id, seq, max((SELECT coalesce(min(i) FILTER (substring(seq, i, 1) <> substring(ahead, i, 1)) - 1, least(length(seq), length(ahead))) FROM (SELECT CAST(unnest(range(1, 91)) AS INT) AS i))) AS n FROM h GROUP BY 1, 2)
SELECT read_id, CAST(n AS INT) AS prefix_len, substring(seq, CAST(n AS INT) + 1) AS tail FROM m""")
def longest_prefix_tail(contigs):
    from ..sources.framing import with_ordinal

    made = contigs.select("chrom", F.concat(F.substring("seq", 11, 60), F.substring("seq", 1, 30)).alias("seq"))
    made = with_ordinal(made, "chrom", start=1).select(F.col("ordinal").alias("read_id"), "seq")
    rows = seeds.seed_align(made, seeds.build_index(contigs, 20), allow_mismatch=False)
    return rows.where("strand = '+'").select("read_id", "prefix_len", "tail")


@query("reads", """WITH x AS (SELECT read_id, k, substring(seq, CAST((read_id * k) % 90 AS INT) + 1) AS tail, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM reads, (SELECT unnest(range(1, 5)) AS k)), r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY length(tail), strand = '-', k) AS n FROM x)
SELECT read_id, strand, length(tail) AS tail_len FROM r WHERE n = 1""")
def min_tail_alignment(reads):
    rows = reads.select("read_id", "seq", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    rows = rows.select("read_id", F.expr("substring(seq, int((read_id * k) % 90) + 1)").alias("tail"), F.expr("IF(k % 2 = 0, '+', '-')").alias("strand"), F.lit(0).alias("prefix_len"), F.col("k").cast("string").alias("alt"))
    return seeds.merged(rows).select("read_id", "strand", F.length("tail").cast("long").alias("tail_len"))


@query("contigs reads")
def seed_align_reads(contigs, reads):
    """Both strands, with one mismatch passed; compared with brute force in the tests."""
    made = reads.select("read_id", "seq")
    return seeds.seed_align(made, seeds.build_index(contigs, 18))


@query("reads")
def adapter_trim_reads(reads):
    """Quality-weighted search with gaps, then disposition: the trimming plan for a known adapter."""
    found = reads.withColumn("a", adapter.adapter_pos("seq", "qual", [ADAPTER1], epsilon=0.2))
    rows = disposition.dispose(found, F.col("a.pos"), min_len=18, end_quality=5)
    return rows.select("read_id", "tag", "pos", F.col("a.idx").alias("idx"))


@query("pairs")
def pair_adapter_joint(pairs):
    """Joint search of both mates."""
    p = pairs.withColumn("p", adapter.pair_pos([ADAPTER1], [ADAPTER2]))
    return p.select("pair_id", "p.pos", "p.idx1", "p.idx2")


# -- profiles -------------------------------------------------------------------------------------------


_CYCLES = "SELECT read_id, i AS cycle, ascii(substring(qual, i, 1)) - 33 AS q FROM (SELECT read_id, qual, CAST(unnest(range(1, length(qual) + 1)) AS INT) AS i FROM reads)"


@query("reads", f"SELECT cycle, count(*) AS n, round(avg(q), 6) AS mean_q FROM ({_CYCLES}) GROUP BY cycle")
def quality_by_cycle(reads):
    return profile.quality_by_cycle(reads).select("cycle", "n", F.round("mean_q", 6).alias("mean_q"))


@query("reads", f"SELECT floor(m / 0.5) * 0.5 AS bin, count(*) AS n FROM (SELECT read_id, avg(q) AS m FROM ({_CYCLES}) GROUP BY read_id) GROUP BY 1")
def read_quality_bins(reads):
    return profile.read_quality_bins(reads)


_MOVES = f"SELECT cycle, prev_q, q, count(*) AS n FROM (SELECT cycle, lag(q) OVER (PARTITION BY read_id ORDER BY cycle) AS prev_q, q FROM ({_CYCLES})) WHERE prev_q IS NOT NULL GROUP BY 1, 2, 3"


@query("reads", _MOVES)
def quality_transitions(reads):
    return profile.transitions(reads)


@query("reads", f"""WITH m AS (SELECT prev_q, q, sum(n) AS n FROM ({_MOVES}) GROUP BY 1, 2)
SELECT prev_q, CAST(sum(n) AS BIGINT) AS n, round(sum(n * q) / sum(n), 6) AS mean,
  round(sqrt(greatest(sum(n * q * q)::DOUBLE / sum(n) - (sum(n * q)::DOUBLE / sum(n)) * (sum(n * q)::DOUBLE / sum(n)), 0.0)), 4) AS sd,
  min(q) AS low, max(q) AS high, arg_max(q, n * 1000 - q) AS mode FROM m GROUP BY prev_q""")
def transition_moments(reads):
    rows = profile.transition_moments(profile.transitions(reads))
    return rows.select("prev_q", "n", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), "low", "high", "mode")


_CALLS = """SELECT substring(a, i, 1) AS ref, i AS cycle, substring(r1, i, 1) AS call, ascii(substring(q1, i, 1)) - 33 AS q, count(*) AS n
  FROM (SELECT r1, q1, reverse(translate(r2, 'ACGT', 'TGCA')) AS a, CAST(unnest(range(1, 101)) AS INT) AS i FROM pairs) WHERE substring(a, i, 1) IN ('A', 'C', 'G', 'T') GROUP BY 1, 2, 3, 4"""


def _calls(pairs):
    return profile.base_calls(pairs.select(S.revcomp("r2").alias("ref_seq"), F.col("r1").alias("seq"), F.col("q1").alias("qual")))


@query("pairs", _CALLS)
def base_call_matrix(pairs):
    return _calls(pairs)


@query("pairs", f"SELECT q, CAST(sum(n) AS BIGINT) AS n, round(sum(n) FILTER (ref <> call) / sum(n), 6) AS mismatch_rate, round(sum(n * pow(10.0, -q / 10.0)) / sum(n), 6) AS expected_rate FROM ({_CALLS}) GROUP BY q")
def mismatch_by_quality(pairs):
    rows = profile.mismatch_rates(_calls(pairs), "q")
    return rows.select("q", "n", F.round("mismatch_rate", 6).alias("mismatch_rate"), F.round("expected_rate", 6).alias("expected_rate"))


@query("pairs", f"SELECT ref, call, round(n / sum(n) OVER (PARTITION BY ref), 6) AS rate FROM (SELECT ref, call, sum(n) AS n FROM ({_CALLS}) GROUP BY 1, 2)")
def base_change_rates(pairs):
    return profile.base_changes(_calls(pairs)).select("ref", "call", F.round("rate", 6).alias("rate"))


@query("pairs", f"WITH c AS ({_CALLS}) SELECT ref, cycle, call, q, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM c WHERE cycle <= 10) GROUP BY 1, 2, 3, 4")
def merged_matrices(pairs):
    c = _calls(pairs)
    return profile.merge_counts(c, c.where("cycle <= 10"))


@query("pairs", "SELECT insert_len AS size, count(*) AS n FROM pairs GROUP BY 1")
def insert_size_hist(pairs):
    rows = pairs.select(F.lit(3).alias("flag"), F.col("insert_len").alias("tlen"))
    return profile.insert_sizes(rows)


@query("pairs", "SELECT count(*) AS total, round(avg(insert_len), 6) AS mean, round(stddev_pop(insert_len), 6) AS sd FROM pairs")
def insert_size_moments(pairs):
    m = profile.weighted_moments(pairs.groupBy(F.col("insert_len").alias("size")).agg(F.count("*").alias("n")))
    return m.select("total", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("pairs", "SELECT round(avg(insert_len), 6) AS mean, round(stddev_samp(insert_len), 6) AS sd FROM (SELECT insert_len FROM pairs ORDER BY pair_id LIMIT 10000)")
def insert_distribution(pairs):
    """The first 10,000 rows are what this report is defined on."""
    m = profile.insert_distribution(pairs.select("pair_id", F.col("insert_len").alias("size")), 10_000, "pair_id")
    return m.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("contigs", """WITH t AS (SELECT chrom, i AS tile, substring(seq, i * 40 + 1, 40) AS s FROM (SELECT chrom, seq, CAST(unnest(range(0, 4)) AS INT) AS i FROM contigs) WHERE length(substring(seq, i * 40 + 1, 40)) > 30),
g AS (SELECT floor(100.0 * length(regexp_replace(s, '[^GC]', '', 'g')) / length(s)) + 0.5 AS gc, CAST(tile * 3 + length(chrom) AS DOUBLE) AS d FROM t),
l AS (SELECT gc, list_sort(array_agg(d)) AS l, count(*) AS n, avg(d) AS mean FROM g GROUP BY gc),
q AS (SELECT *, CASE WHEN n < 4 - n % 2 THEN 0 WHEN n % 2 = 1 THEN l[(n + 1) // 4] ELSE l[(n + 1) // 4] + (l[(n + 1) // 4 + 1] - l[(n + 1) // 4]) * ((n + 1) / 4.0 - (n + 1) // 4) END AS q1,
  CASE WHEN n < 4 - n % 2 THEN 0 WHEN n % 2 = 1 THEN l[(n + 1) // 2] ELSE (l[n // 2] + l[n // 2 + 1]) / 2 END AS q2, CASE WHEN n < 4 - n % 2 THEN 0 ELSE l[(n + 1) // 4 * 3] END AS q3 FROM l)
SELECT CAST(gc AS DOUBLE) AS gc, n, round(mean, 6) AS mean, CAST(q1 AS DOUBLE) AS q1, CAST(q2 AS DOUBLE) AS q2, CAST(q3 AS DOUBLE) AS q3,
  coalesce(list_min(list_filter(l, lambda x: x > q1 - 1.5 * (q3 - q1))), l[n]) AS whisker_low,
  coalesce(list_max(list_filter(l, lambda x: x <= q3 + 1.5 * (q3 - q1))), l[1]) AS whisker_high, l[1] AS low, l[n] AS high FROM q""")
def gc_depth(contigs):
    w = profile.tiles(contigs, 40).withColumn("depth", F.col("tile") * 3 + F.length("chrom"))
    return profile.gc_depth(w).withColumn("mean", F.round("mean", 6)).withColumn("gc", F.col("gc").cast("double"))


@query("reads", """SELECT tile, prefix, round(sum(s) / sum(n), 6) AS mean_q FROM (SELECT CAST(read_id % 4 AS STRING) AS tile, p AS prefix, length(h) AS n,
  list_sum(list_transform(string_split(h, ''), lambda c: ascii(c) - 33)) AS s
  FROM (SELECT read_id, p, CASE WHEN p = 0 THEN qual ELSE substring(qual, 1, p) END AS h FROM reads, (SELECT unnest([0, 1, 5, 10, 15, 30, 50]) AS p))) GROUP BY 1, 2""")
def tile_quality(reads):
    named = reads.withColumn("name", F.format_string("m:1:%d:5", F.col("read_id") % 4))
    return profile.tile_quality(named).withColumn("mean_q", F.round("mean_q", 6))


@query("pairs", "SELECT pair_id FROM pairs WHERE length(substring(r1, 1, insert_len)) >= 60 AND length(r2) >= 60")
def cut_length_pairs(pairs):
    return profile.drop_short(pairs.withColumn("s1", F.expr("substring(r1, 1, insert_len)")), 60, "s1", "r2").select("pair_id")


@query("tails", f"SELECT kmer, count(*) AS cnt FROM ({_KMERS}) GROUP BY kmer ORDER BY cnt DESC, kmer LIMIT 1")
def top_kmer(tails):
    return profile.best_kmer(kmers.kmer_counts(tails, 10))


# -- record ranges -----------------------------------------------------------------------------------------


@query("reads", """WITH o AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS k, count(*) OVER () AS n FROM reads)
SELECT segment, count(*) AS n, min(read_id) AS first FROM (SELECT read_id, CAST(CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS segment FROM o) GROUP BY segment""")
def segments(reads):
    return ranges.segment(reads.select("read_id"), 7, "read_id").groupBy("segment").agg(F.count("*").alias("n"), F.min("read_id").alias("first"))


@query("reads", "SELECT insert_len AS k, arg_min(name, read_id) AS name FROM reads GROUP BY 1")
def first_value_map(reads):
    return ranges.to_map(reads.withColumnRenamed("insert_len", "k"), "k", "name", "read_id")


@query("reads", "SELECT read_id, CAST(p AS INT) - 1 AS part_no, string_split(name, '_')[p] AS part FROM (SELECT read_id, name, unnest(range(1, 3)) AS p FROM reads)")
def split_names(reads):
    return ranges.split(reads, "name", "_").select("read_id", "part_no", "part")


# -- alignments as text --------------------------------------------------------------------------------------


def _aligned(reads):
    loci = F.transform(F.sequence(F.lit(1), F.col("read_id") % 3 + 1), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("chrom"), (F.col("read_id") % 1000 * i).alias("pos")))
    strand = F.when(F.col("read_id") % 2 == 1, "-").otherwise("+")
    size = F.least("insert_len", F.lit(100))
    return reads.select("read_id", "name", "seq", "qual", strand.alias("strand"), size.alias("prefix_len"), F.expr("substring(seq, insert_len + 1)").alias("tail"), loci.alias("loci"), F.lit(6).alias("n"))


_LOCI = """SELECT *, CAST(unnest(range(1, read_id % 3 + 2)) AS BIGINT) AS i, substring(seq, insert_len + 1) AS tail, least(insert_len, 100) AS p FROM reads"""


@query("reads", f"""SELECT array_to_string([name, CASE WHEN read_id % 2 = 1 THEN '16' ELSE '0' END, concat('c', CAST(i AS STRING)), CAST(read_id % 1000 * i + 1 AS STRING), CAST(255 - length(tail) AS STRING),
  CASE WHEN tail = '' THEN concat(CAST(p AS STRING), 'M') WHEN read_id % 2 = 1 THEN concat(CAST(length(tail) AS STRING), 'S', CAST(p AS STRING), 'M') ELSE concat(CAST(p AS STRING), 'M', CAST(length(tail) AS STRING), 'S') END,
  '*', '0', '0', CASE WHEN read_id % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, CASE WHEN read_id % 2 = 1 THEN reverse(qual) ELSE qual END,
  concat('NH:i:', CAST(read_id % 3 + 1 AS STRING), CASE WHEN tail <> '' THEN concat(chr(9), 'TL:Z:', tail) ELSE '' END)], chr(9)) AS line FROM ({_LOCI})""")
def sam_lines(reads):
    return alignments.aligned_sam(_aligned(reads)).select(alignments.sam_text().alias("line"))


@query("reads", f"""SELECT concat('c', CAST(i AS STRING)) AS chrom, CAST(read_id % 1000 * i AS BIGINT) AS begin, CAST(read_id % 1000 * i + p AS BIGINT) AS stop,
  CASE WHEN read_id % 2 = 1 THEN '-' ELSE '+' END AS strand, name, round(6.0 / (read_id % 3 + 1), 6) AS reads FROM ({_LOCI})""")
def bed_rows(reads):
    return alignments.to_bed(_aligned(reads)).select("chrom", "begin", "stop", "strand", "name", F.round("reads", 6).alias("reads"))


@query("reads", f"SELECT read_id, concat('c', CAST(i AS STRING)) AS chrom, CAST(read_id % 1000 * i AS BIGINT) AS begin, CAST(read_id % 1000 * i + p - 1 AS BIGINT) AS stop FROM ({_LOCI})")
def alignment_locations(reads):
    return intervals.to_locations(_aligned(reads)).select("read_id", "chrom", "begin", "stop")


@query("reads", f"""SELECT read_id, array_to_string(['@' || name, seq, '+', qual], chr(10)) AS fastq, concat('>', name, chr(10), seq) AS fasta FROM reads""")
def read_text(reads):
    return reads.select("read_id", io.fastq_text().alias("fastq"), io.fasta_text().alias("fasta"))


@query("pairs")
def assembled_adapters(pairs):
    """Adapters of both mates found from mate overlap: the detection plan, one row."""
    a, b = modes.detect_paired(pairs)
    return pairs.sparkSession.createDataFrame([(a, b)], "adapter1 string, adapter2 string")


@query("contigs")
def simulated_pairs(contigs):
    """1,000 pairs drawn from the contigs, with the truth; errors are drawn by seeded generators."""
    frags = simulate.fetch(simulate.draw_fragments(contigs.sparkSession, contigs, 1000, 60, 20), contigs)
    made = simulate.read_pairs(frags, 100, (ADAPTER1, ADAPTER2))
    return simulate.with_errors(made, "r1", "q1").select("read_id", "chrom", "pos", "strand", "insert_len", "r1", "q1", "truth_len", "r1_subs")


@query("contigs")
def second_haplotype(contigs):
    """SNPs, indels and inversions put into every contig."""
    return simulate.diploid(contigs, 0.02, 0.01, 0.001, 20).select("chrom", "seq", F.size("variants").alias("n_variants"))


@query("reads")
def quality_masking(reads):
    """Where the low-quality suffix of each read begins."""
    return reads.select("read_id", simulate.masked_from().alias("masked_from"))


@query("reads contigs")
def small_rna_trim(reads, contigs):
    """Seed lengths tried against the contigs, the best one's trimming."""
    done, _ = modes.small_rna(reads.select("read_id", "name", "seq", "qual"), contigs, (18, 20), min_len=18)
    return done.reads.select("read_id", "tag", "pos")

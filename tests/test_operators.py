import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import register
from readloom.functions import sequence as S
from readloom.operators import adapter, chunks, disposition, evaluate, intervals, kmers, overlap, profile, ranges, seeds, simulate
from readloom.plans import modes
from readloom.plans.views import ADAPTER1, ADAPTER2
from readloom.sources import reads as io
from readloom.streaming import trim as stream

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMP)


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTNNac", "!5?IIII~", "4M2I10N3=", "r7/1")], "s string, q string, c string, n string")
    row = df.select(
        S.revcomp("s").alias("rc"), S.gc_percent("s").alias("gc"), S.mean_quality("q").alias("m"), S.quality_trim3(F.lit("II#!"), 3).alias("t"),
        S.reference_length(S.cigar_ops("c")).alias("rl"), S.query_length(S.cigar_ops("c")).alias("ql"), S.n_runs("s").alias("runs"), S.name_key("n").alias("k"),
        S.read_number("n").alias("num"), S.masked("s", F.lit(2)).alias("mask"), S.n_filled("s", F.lit(2)).alias("fill"), S.phred(F.lit(0.001)).alias("ph"),
        S.is_blurry("s", 0.1).alias("b"), S.quality_passes(F.lit(""), 30).alias("empty"), S.cigar_text(S.cigar_ops(F.lit("*"))).alias("star"),
    ).first()
    assert (row["rc"], row["mask"], row["fill"], row["k"], row["num"]) == ("GTNNACGT", "ACgtnnac", "ACNNNNNN", "r7", 7)
    assert row["gc"] == pytest.approx(100 * 3 / 6) and row["m"] == pytest.approx(sum(map(ord, "!5?IIII~")) / 8 - 33)
    assert (row["t"], row["rl"], row["ql"], row["b"], row["empty"], row["star"]) == (2, 17, 9, True, True, "*")
    assert [tuple(x) for x in row["runs"]] == [(4, 2)] and row["ph"] == pytest.approx(30)


def test_quality_sums(spark):
    r = random.Random(12)
    texts = ["".join(chr(r.randint(33, 126)) for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "q string").repartition(3)
    assert df.where(~S.quality_sum("q").eqNullSafe(S.quality_sum_expr("q"))).count() == 0


def test_reg2bin(spark):
    r = random.Random(3)
    rows = [(b, b + r.randint(1, 1 << r.randint(1, 27))) for b in (r.randint(0, 1 << 28) for _ in range(200))]
    got = spark.createDataFrame(rows, "b long, e long").select("b", "e", S.reg2bin("b", "e").alias("bin"), S.reg2bins("b", "e").alias("bins")).collect()
    for x in got:
        want = next((off + (x.b >> s) for s, off in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) if x.b >> s == (x.e - 1) >> s), 0)
        assert x.bin == want and want in x.bins


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT revcomp('AACg'), hamming('ACN', 'ACN')").first()[:] == ("CGTT", 1)
    assert [tuple(x) for x in spark.sql("SELECT * FROM kmers('ACGT', 3) ORDER BY pos").collect()] == [(0, "ACG"), (1, "CGT")]
    assert spark.sql("SELECT * FROM kmers('AC', 3)").count() == 0
    a = "ACGT" * 10
    assert spark.sql(f"SELECT overlap_insert_len('{a}', '{rc(a)}'), adapter_pos('{'C' * 30 + ADAPTER1}', NULL, '{ADAPTER1}').pos").first()[:] == (40, 30)


def brute_insert(a, b, adapters=None):
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    same = lambda x, y: sum(p == q and p != "N" for p, q in zip(x, y))
    any_candidate = False
    for i in range(n, 15, -1):
        if same(a[i - 16 : i], rc(b[:16])) < 11.2 or same(b[i - 16 : i], rc(a[:16])) < 11.2:
            continue
        any_candidate = True
        if (adapters and i == n) or same(a[:i], rc(b[:i])) * 10 < 9 * i:
            continue
        if adapters:
            ok = [same(x[i : i + len(t)], t) * 10 >= 8 * min(len(t), n - i) for x, t in ((a, adapters[0]), (b, adapters[1]))]
            if not any(ok):
                continue
        return i
    if adapters and not any_candidate:
        for x, t in ((a, adapters[0]), (b, adapters[1])):
            for at in range(16):
                m = min(16, len(t), n - at)
                if m >= 5 and same(x[at : at + m], t[:m]) * 10 > 8 * m:
                    return at
    return n


def pairs_list(n=120, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.randint(0, 130)
        f = dna(r, size)
        a, b = (f + ADAPTER1 + "A" * 100)[:100], (rc(f) + ADAPTER2 + "A" * 100)[: 100 if i % 3 else 90]
        for _ in range(i % 5):
            k = r.randrange(len(a))
            a = a[:k] + r.choice("ACGTN") + a[k + 1 :]
        out.append((i, a, b, "I" * 100, "I" * len(b), size))
    return out


def test_overlap_matches_brute_force(spark):
    rows = pairs_list()
    for ad in (None, (ADAPTER1, ADAPTER2)):
        got = overlap.scan([x[1] for x in rows], [x[2] for x in rows], ad)
        assert got.tolist() == [brute_insert(x[1], x[2], ad) for x in rows]
    df = spark.createDataFrame(rows[:40], "pair_id long, r1 string, r2 string, q1 string, q2 string, truth int")
    both = df.select(overlap.insert_len_expr().alias("a"), overlap.insert_len().alias("b"))
    assert both.where("a <> b").count() == 0
    cut = overlap.trim_pairs(df, (ADAPTER1, ADAPTER2), 20)
    assert cut.where("length(r1) < 20 OR length(r1) <> length(r2) OR length(q1) <> length(r1)").count() == 0
    assert overlap.scan([], []).tolist() == [] and overlap.scan(["ACG"], ["ACG"]).tolist() == [3]


def brute_align(read, adapter_text, eps, gaps):
    """Least cost of the whole adapter, or of a prefix that reaches the read's end, by plain dynamic programming."""
    n, m = len(read), len(adapter_text)
    best = {}
    big = float("inf")
    table = [[[0.0 if g == 0 else big for _ in range(n + 1)] for g in range(gaps + 1)]]
    for j in range(1, m + 1):
        row = [[big] * (n + 1) for _ in range(gaps + 1)]
        for g in range(gaps + 1):
            for i in range(n + 1):
                c = big
                if i:
                    c = table[-1][g][i - 1] + (0 if read[i - 1] == adapter_text[j - 1] else adapter.MU)
                if g:
                    c = min(c, table[-1][g - 1][i] + adapter.GAP)
                    if i:
                        c = min(c, row[g - 1][i - 1] + adapter.GAP)
                row[g][i] = c
        table.append(row)
        best[j] = min(row[g][n] for g in range(gaps + 1))
    whole = min(min(table[m][g]) for g in range(gaps + 1))
    scores = [(m * adapter.MU - whole) / (m + 1)] if whole < eps * adapter.MU * m + 0.001 else []
    least = min(adapter.default_overlap(eps), m - gaps + 1)
    scores += [(j * adapter.MU - best[j]) / (j + 1) for j in range(least, m) if best[j] < eps * adapter.MU * j + 0.001]
    return max(scores, default=None)


def test_adapter_scores_match_brute_force():
    r = random.Random(5)
    ad = ADAPTER1[:20]
    texts = []
    for i in range(80):
        t = dna(r, r.randint(0, 40)) + ad + dna(r, r.randint(0, 15))
        k = r.randrange(max(1, len(t)))
        t = {0: t, 1: t[:k] + t[k + 1 :], 2: t[:k] + "G" + t[k:], 3: t[: len(t) - r.randint(0, 18)]}[i % 4]
        texts.append(t)
    pos, idx, score = adapter.scan(texts, None, [ad], delta=0.05)
    for t, i, s in zip(texts, idx, score):
        want = brute_align(t, ad, 0.1, 1)
        assert (want is None) == (i < 0) and (want is None or s == pytest.approx(want))


def test_adapter_modes_and_ties():
    ad = ADAPTER1[:16]
    assert adapter.scan(["CCCC" + ad + "GG"], None, [ad])[0].tolist() == [4]
    assert adapter.scan([ad + "CCCCC"], None, [ad], mode="head")[0].tolist() == [5]
    found = [adapter.scan([ad[6:] + "C" * 30], None, [ad], mode=m, epsilon=0.2)[1].tolist() for m in ("any", "tail")]
    assert found == [[0], [-1]]
    pos, idx, _ = adapter.scan(["CC" + ad, ""], None, [ad, ad])
    assert (pos.tolist(), idx.tolist()) == ([2, 0], [0, -1])
    low_q = adapter.scan(["CCCC" + "C" + ad[1:]], ["!" * 20], [ad], epsilon=0.05)[1].tolist()
    high_q = adapter.scan(["CCCC" + "C" + ad[1:]], ["I" * 20], [ad], epsilon=0.05)[1].tolist()
    assert (low_q, high_q) == ([0], [-1])
    assert adapter.scan(["CCCCAGATCGGNAGAGCACA"], None, ["AGATCGGRAGAGCACA"], epsilon=0.1)[1].tolist() == [0]
    assert adapter.pair_matrix([("x", "a", True), ("x", "b", False)], ["x"], ["a", "b"]) == {(0, 0)}


def test_pair_amplicon_and_junction(spark):
    rows = pairs_list(60)
    df = spark.createDataFrame([x for x in rows if x[5] >= 20], "pair_id long, r1 string, r2 string, q1 string, q2 string, truth int")
    joint = modes.paired_joint(df, [ADAPTER1], [ADAPTER2], mean_quality=10)
    right = joint.where("abs(pos - least(truth, 100)) <= 1").count()
    assert right >= 0.9 * joint.count()
    assert modes.paired_separate(df, [ADAPTER1], [ADAPTER2]).count() == df.count()
    f, v, mid = "ACGTTGCAACGTAC", "GGATCCTTAAGCGT", "CATTAGGCATCCAGGATTACAGGCAT"
    one, two = f + mid + rc(v), rc(f + mid + rc(v))
    amp = spark.createDataFrame([("a", one, "I" * len(one)), ("b", two, "I" * len(two)), ("c", mid, "I" * len(mid))], "name string, seq string, qual string")
    got = {r["name"]: r for r in modes.amplicon(amp, [f], [v]).collect()}
    assert got["a"]["seq"] == got["b"]["seq"] == mid and got["b"]["exchanged"] and got["c"]["tag"] == "UNDETERMINED"
    j = "CTGTCTCTTATACACATCT"
    r = random.Random(1)
    left, right = dna(r, 40), dna(r, 30)
    mp = spark.createDataFrame([(0, left + j + right, dna(r, 10), "I" * 89, "I" * 10)], "pair_id long, r1 string, r2 string, q1 string, q2 string")
    x = modes.mate_pair(mp, j).first()
    assert (x["r1"], x["r2"], x["tag"]) == (left, rc(right), "NORMAL")


def test_consensus(spark):
    df = spark.createDataFrame([("ACGT", "!I!I", "TTTT", "5555"), ("AC", "I", "GT", "II")], "r1 string, q1 string, r2 string, q2 string")
    got = [tuple(r) for r in df.select(overlap.consensus().alias("c")).select("c.*").collect()]
    assert got == [("ACAT", "5I5I"), ("AC", "I")]


def test_assembly(spark):
    r = random.Random(7)
    frags = [(i, (ADAPTER1 + "A" * 10)[: r.randint(12, 40)]) for i in range(600)]
    df = spark.createDataFrame(frags, "frag_id long, tail string")
    text, low = kmers.assemble(df)
    assert text.startswith(ADAPTER1[:20]) and not low
    assert kmers.assemble(df.limit(0)) == ("", False)
    poly = spark.createDataFrame([(i, "A" * 12 + "CGTACG") for i in range(500)], "frag_id long, tail string")
    assert kmers.assemble(poly, sensitive=True)[1]
    assert kmers.umi_size(df.withColumn("tail", F.concat(F.lit("CCC"), "tail")), ADAPTER1) == 3
    graph = {"a": {"b": 3}, "b": {"c": 3, "d": 2}}
    assert kmers.simple_paths(graph) == [["a", "b", "c"], ["a", "b", "d"]] and not kmers.has_cycle(graph)
    assert kmers.has_cycle({"a": {"b": 1}, "b": {"a": 1}}) and '"a" -> "b" [label=3];' in kmers.to_dot(graph)


def test_seed_alignment(spark):
    r = random.Random(9)
    contigs = [dna(r, 120) for _ in range(4)] + [dna(r, 2500)]
    reads = []
    for i in range(60):
        c = r.choice(contigs)
        p = r.randrange(len(c) - 60)
        s = c[p : p + r.randint(15, 50)] + dna(r, r.randint(0, 20))
        reads.append((i, rc(s) if i % 2 and len(s) < 30 else s if i % 2 == 0 else rc(c)[p : p + 40] + "ACGTACG"))
    reads.append((99, "ACGTN" * 10))
    df = spark.createDataFrame(reads, "read_id long, seq string")
    table = modes.build(spark.createDataFrame([(f"c{i}", c.lower() if i == 1 else c) for i, c in enumerate(contigs)], "chrom string, seq string"), 14)
    got = {(x["read_id"], x["strand"], x["prefix_len"]) for x in seeds.seed_align(df, table, allow_mismatch=False).collect()}
    want = set()
    for i, s in reads:
        if "N" in s:
            continue
        for strand in "+-":
            best = 0
            for c in contigs:
                c = c if strand == "+" else rc(c)
                for p in range(len(c)):
                    j = 0
                    while j < len(s) and p + j < len(c) and c[p + j] == s[j]:
                        j += 1
                    best = max(best, j)
            if best >= 14:
                want.add((i, strand, best))
    assert got == want
    c = contigs[0]
    mm = spark.createDataFrame([(1, c[:30] + ("A" if c[30] != "A" else "C") + c[31:50] + "TTTTTGGGGG")], "read_id long, seq string")
    x = seeds.seed_align(mm, table).first()
    assert x["mismatch_at"] == 30 and x["alt"] == c[30] and x["prefix_len"] >= 50
    bad = spark.createDataFrame([(1, c[:5] + ("A" if c[5] != "A" else "C") + c[6:30])], "read_id long, seq string")
    assert [tuple(h) for h in seeds.seed_mismatch(bad, table).collect()] == [(1, "c0", 0)]
    assert seeds.seed_align(df, table, max_align=1).where("n_loci > 1").count() == 0
    assert seeds.shortest_tail(seeds.seed_align(df, table)).count() >= seeds.merged(seeds.seed_align(df, table)).count()


def test_seed_alignment_with_mismatch_in_the_seed_and_long_reads(spark):
    r = random.Random(12)
    c = dna(r, 4000)
    other = lambda s, i: s[:i] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[i]] + s[i + 1 :]
    table = modes.build(spark.createDataFrame([("c", c)], "chrom string, seq string"), 14)
    reads = {i: other(c[100 * i : 100 * i + 40], i) for i in (0, 1, 6, 7, 12)} | {i + 20: other(rc(c[100 * i : 100 * i + 40]), i) for i in (0, 6, 12)}
    df = spark.createDataFrame(list(reads.items()), "read_id long, seq string")
    got = {(x["read_id"], x["strand"], x["mismatch_at"], x["prefix_len"], x["tail"]) for x in seeds.seed_align(df, table).collect()}
    assert got == {(i, "+" if i < 20 else "-", i % 20, 40, "") for i in reads}
    assert seeds.seed_align(df, table, allow_mismatch=False).count() == 0
    # of two places the one with the shortest tail, though the exact prefix of the other is longer
    seed = dna(r, 14)
    two = modes.build(spark.createDataFrame([("a", other(seed, 3) + c[:40]), ("b", other(seed, 9) + c[50:90])], "chrom string, seq string"), 14)
    x = seeds.seed_align(spark.createDataFrame([(1, seed + c[:40])], "read_id long, seq string"), two).collect()
    assert [(y["mismatch_at"], y["prefix_len"]) for y in x] == [(3, 54)]
    long = {1: c[900:1200], 2: c[50:3950] + "ACG", 3: rc(c[900:1300]), 4: rc(c[:3000]), 5: c[1000:1300]}
    df = spark.createDataFrame(list(long.items()), "read_id long, seq string")
    rows = {x["read_id"]: (x["strand"], x["prefix_len"]) for x in seeds.seed_align(df, table, allow_mismatch=False).collect()}
    assert rows[1] == ("+", 300) and rows[3] == ("-", 400) and rows[4] == ("-", 3000) and rows[5] == ("+", 300) and rows[2][1] >= 3900


def test_seed_look_ups_agree(spark, monkeypatch):
    r = random.Random(31)
    contigs = [dna(r, 700), "A" * 90 + dna(r, 60), dna(r, 2300)[:1100] + "N" + dna(r, 1100), "ACGT"]
    contigs.append(contigs[0][100:300])
    flip = lambda s, i: s[:i] + r.choice("ACGT".replace(s[i], "")) + s[i + 1 :]
    reads = []
    for i in range(150):
        c = r.choice(contigs[:3] + contigs[4:])
        p = r.randrange(len(c) - 50)
        s = c[p : p + r.randint(8, 50)]
        s = rc(s) if i % 2 else s
        for _ in range(i % 4):
            s = flip(s, r.randrange(len(s)))
        reads.append((i, s[:5] + "R" + s[6:] if i % 10 == 9 else s.lower() if i % 10 == 8 else s))
    table = seeds.build_index(spark.createDataFrame([(f"c{i}", c) for i, c in enumerate(contigs)], "chrom string, seq string"), 12)
    df = spark.createDataFrame([*reads, (500, "A" * 40), (501, None), (502, "")], "read_id long, seq string")
    want = set()
    for i, s in [*((i, s.upper()) for i, s in reads), (500, "A" * 40)]:
        for strand in "+-" if len(s) >= 12 and "N" not in s else "":
            seed = s[:12] if strand == "+" else S_revcomp(s[:12])
            far = [(sum(x != y for x, y in zip(seed, c[p : p + 12])), f"c{j}", p) for j, c in enumerate(contigs) for p in range(len(c) - 11) if "N" not in c[p : p + 12]]
            best = [x for x in far if x[0] == 0] or [x for x in far if x[0] == 1]
            want |= {(i, strand, c, p) for _, c, p in best}
    usable = df.selectExpr("read_id", "upper(seq) AS seq").where("length(seq) >= 12 AND NOT contains(seq, 'N')")
    joined = {tuple(x) for x in seeds._by_text(usable, table, True).select("read_id", "strand", "chrom", "pos").collect()}
    assert joined == want and len(want) > 200
    for look in (seeds._few, seeds._many):
        got = [tuple(x) for x in look(usable, table, True).select("read_id", "strand", "chrom", "pos").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        exact = {tuple(x) for x in look(usable, table, False).select("read_id", "strand", "chrom", "pos").collect()}
        assert exact == {tuple(x) for x in seeds._by_text(usable, table, False).select("read_id", "strand", "chrom", "pos").collect()}
    rows = sorted(map(str, seeds.seed_align(df, table).collect()))
    for name, value in (("FEW", -1), ("NUMERIC", 0)):
        monkeypatch.setattr(seeds, name, value)
        assert sorted(map(str, seeds.seed_align(df, table).collect())) == rows
    # k-mers with an equal half are not joined: such pairs grow with the square of the tables
    monkeypatch.undo()
    assert "levenshtein" not in seeds.seed_align(df, table)._jdf.queryExecution().toString()


def test_small_rna_goes_through_reads_once_for_an_adapter(spark):
    r = random.Random(41)
    inserts = [dna(r, r.randint(20, 40)) for _ in range(300)]
    contigs = spark.createDataFrame([(f"c{i}", s + dna(r, 30)) for i, s in enumerate(inserts)], "chrom string, seq string")
    made, seen = spark.createDataFrame([(i, f"r{i}", (s + ADAPTER1 + "A" * 60)[:75], "I" * 75) for i, s in enumerate(inserts)], "read_id long, name string, seq string, qual string"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    done, best = modes.small_rna(made.mapInArrow(counted, made.schema), contigs, (18, 20), min_len=18)
    assert done.adapter[:20] == ADAPTER1[:20] and done.reads.where("tag = 'NORMAL' AND pos BETWEEN 18 AND 41").count() == 300
    assert seen.value <= 4 * 300  # ids of the sample, the sample, trimming; each seed length went through them again
    x = best.first()
    assert x["seed_len"] == 20 and x["percent"] == 100


def test_index_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([("c", "ACGTTGCAAGGCTTACGATTTGC")], "chrom string, seq string")
    table = modes.build(contigs, 8, str(tmp_path / "idx"))
    assert table.kmers.count() == 16
    with pytest.raises(ValueError):
        seeds.load_index(spark, str(tmp_path / "idx"), 9)


def test_modes_on_simulated_reads(spark):
    r = random.Random(11)
    contigs = spark.createDataFrame([(f"c{i}", dna(r, 3000)) for i in range(4)], "chrom string, seq string")
    frags = simulate.fetch(simulate.draw_fragments(spark, contigs, 1500, 70, 20, seed=3), contigs)
    made = simulate.read_pairs(frags, 100, (ADAPTER1, ADAPTER2))
    made = simulate.with_errors(simulate.with_errors(made, "r1", "q1", seed=1), "r2", "q2", seed=2).withColumn("pair_id", F.col("read_id")).persist()
    assert made.where("length(r1) <> 100 OR length(q1) <> 100").count() == 0
    out, adapters = modes.paired(made, 1)
    assert adapters[0].startswith(ADAPTER1[:15]) and adapters[1].startswith(ADAPTER2[:15])
    truth = made.select(F.col("pair_id").alias("name"), F.col("truth_len").alias("len"))
    scored = evaluate.outcomes(out.select(F.col("pair_id").alias("name"), F.length("r1").alias("len")), truth, 100)
    m = evaluate.metrics(evaluate.confusion(scored)).first()
    assert m["acc"] > 0.97 and m["sen"] > 0.97
    single = made.select("read_id", F.col("r1").alias("seq"), F.col("q1").alias("qual"), "truth_len")
    done = modes.single(single, modes.build(contigs, 20), min_len=1)
    assert done.adapter.startswith(ADAPTER1[:12])
    close = done.reads.where("abs(pos - truth_len) <= 3").count()
    assert close > 0.9 * single.count()
    small, best = modes.small_rna(single.limit(400), contigs, (18, 20), min_len=1)
    assert best.first()["seed_len"] in (18, 20) and small.reads.count() == 400
    made.unpersist()


def test_simulated_truth_and_variants(spark):
    r = random.Random(2)
    contigs = spark.createDataFrame([("c1", dna(r, 5000)), ("c2", "N" * 50)], "chrom string, seq string")
    frags = simulate.fetch(simulate.draw_fragments(spark, contigs, 200, 150, 30, seed=5), contigs, chunk=512)
    text = {x["chrom"]: x["seq"] for x in contigs.collect()}
    for x in frags.collect():
        want = text[x["chrom"]][x["pos"] : x["pos"] + x["insert_len"]]
        assert x["frag"] == (want if x["strand"] == "+" else rc(want))
    assert sorted(map(tuple, simulate.draw_fragments(spark, contigs, 50, 150, 30, seed=5).collect())) == sorted(map(tuple, simulate.draw_fragments(spark, contigs, 50, 150, 30, seed=5).collect()))
    v = {x["chrom"]: x for x in simulate.diploid(contigs, 0.01, 0.005, 0.0005, 20).collect()}
    assert v["c2"]["seq"] == "N" * 50 and len(v["c1"]["variants"]) > 20
    again, shift = text["c1"], 0
    for x in v["c1"]["variants"]:
        at = x["pos"] + shift
        assert again[at : at + len(x["ref"])] == x["ref"]
        again = again[:at] + x["alt"] + again[at + len(x["ref"]) :]
        shift += len(x["alt"]) - len(x["ref"])
    assert again == v["c1"]["seq"]
    assert simulate.apply_indels("ACGT", [(1, 2, "GG"), (3, -1, "")]) == "AGGCG"
    kept = simulate.gc_accept(frags, {g: 0.5 for g in range(101)}).count()
    assert 60 < kept < 140


def test_quality_mask():
    assert simulate.quality_mask([40] * 10, "A" * 10) == 10
    assert simulate.quality_mask([40] * 10 + [2] * 5, "A" * 15) == 10
    assert simulate.quality_mask([40] * 4 + [40] * 12 + [2] * 5, "ACTC" + "G" * 12 + "ACTAC") <= 16
    assert simulate.quality_mask([], "") == 0


def test_interval_joins_match_brute_force(spark):
    r = random.Random(6)
    make = lambda n, w: [(f"c{r.randint(1, 2)}", b := r.randint(0, 3000), b + r.randint(0, w), i) for i in range(n)]
    q, d = make(80, 300), make(150, 90)
    qs, ds = (spark.createDataFrame(x, "chrom string, begin long, stop long, id long") for x in (q, d))
    hits = sorted((a[3], b[3]) for a, b in itertools.product(q, d) if a[0] == b[0] and a[1] <= b[2] and a[2] >= b[1])
    for width in (1, 64, 10_000):
        assert sorted(map(tuple, intervals.overlap_join(qs, ds, width=width).select("id", "db_id").collect())) == hits
    lists = {x["id"]: x["hits"] for x in intervals.overlap_lists(qs, ds).collect()}
    assert lists == {i: sorted(b for a, b in hits if a == i) for i in range(80)}
    assert intervals.overlap_join(qs, ds, "left").select("id").distinct().count() == 80
    depth = {}
    for x in intervals.coverage(qs, ds).collect():
        assert x["stop"] > x["begin"]
        for p in range(x["begin"], x["stop"]):
            depth[x["id"], p] = x["depth"]
    for a in q[:30]:
        for p in range(a[1], a[2]):
            assert depth[a[3], p] == sum(b[0] == a[0] and b[1] <= p < b[2] for b in d)
    assert intervals.overlap_join(qs.limit(0), ds).count() == 0


def _shuffled_bytes(spark, job):
    """Bytes that the stages of ``job`` write for shuffles, and its result."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    count = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in _items(store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList()))}
    before = count()
    out = job()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in count().items() if k not in before), out


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_interval_lists_shuffle_no_pairs(spark):
    # one place with 1,500 intervals on both sides: 2,250,000 pairs, which were all shuffled to be grouped by query
    q = spark.range(1500).selectExpr("'c' AS chrom", "1000 + id % 7 AS begin", "1010 + id % 7 AS stop", "id")
    n, rows = _shuffled_bytes(spark, lambda: intervals.overlap_lists(q, q).selectExpr("id", "size(hits) AS n").collect())
    assert {x["n"] for x in rows} == {1500} and len(rows) == 1500
    assert n < 500_000
    # lengths far apart, ids of several digits and signs, rows without a hit, a place or an order
    r = random.Random(11)
    make = lambda n, sign: [(f"c{r.randint(1, 2)}", b := r.randint(-500, 60_000), b + r.choice([0, 3, 50, 700, 30_000]) - (i == 5), sign * i * i * 37) for i in range(n)]
    a, b = make(150, 1) + [(None, 1, 9, -1), ("c1", None, 9, -2), ("c9", 1, 9, -3)], make(400, -1) + make(300, 1) + [("c1", 7, 9, None)]
    qs, ds = (spark.createDataFrame(x, "chrom string, begin long, stop long, id long") for x in (a, b))
    want = {x[3]: sorted(y[3] for y in b if y[3] is not None and x[0] == y[0] and x[1] is not None and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and x[2] >= y[1]) for x in a}
    for width in (None, 1, 64, 10_000):
        assert {x["id"]: x["hits"] for x in intervals.overlap_lists(qs, ds, width=width).collect()} == want
    texts = {k: ",".join(map(str, v)) for k, v in want.items()}
    assert {x["id"]: x["hits"] for x in intervals.overlap_lists(qs, ds, sep=",").collect()} == texts
    assert {x["id"]: x["hits"] for x in intervals.overlap_lists(qs, ds.withColumn("id", F.col("id").cast("string")), sep=", ").collect()} == {k: ", ".join(sorted(map(str, v))) for k, v in want.items()}


def test_scoring(spark):
    truth = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 50), ("e", 0), ("f", 9)], "name string, len int")
    out = spark.createDataFrame([("a", 100), ("b", 50), ("c", 60), ("d", 40)], "name string, len int")
    s = evaluate.outcomes(out, truth, 100)
    assert {r["name"]: r["outcome"] for r in s.collect()} == {"a": "TN", "b": "TP", "c": "FN", "d": "FP", "e": "TP", "f": "FP"}
    assert tuple(evaluate.confusion(s).first()) == (2, 1, 2, 1)
    assert tuple(evaluate.trim_errors(s).first()) == (10, 19)
    p = spark.createDataFrame([("x", "N", "ACG"), ("y", "AC", "ACG")], "name string, r1 string, r2 string")
    assert sorted(map(tuple, evaluate.paired_lengths(p).collect())) == [("x", 0), ("y", 2)]


def test_disposition(spark):
    rows = [("n", "ACGTACGTAC", "IIIIIIIIII"), ("blur", "NNNNNACGTA", "IIIIIIIIII"), ("low", "ACGTACGTAC", "##########"), ("end", "ACGTACGTAC", "IIII######"), ("", "", "")]
    df = spark.createDataFrame(rows, "name string, seq string, qual string")
    got = {r["name"]: (r["tag"], r["pos"]) for r in disposition.dispose(df, min_len=5, drop_blurry=True, mean_quality=10, end_quality=5).collect()}
    assert got == {"n": ("NORMAL", 10), "blur": ("BLURRY", 10), "low": ("BADQUAL", 0), "end": ("SHORT", 4), "": ("EMPTY", 0)}
    cut = disposition.dispose(df.where("name = 'n'"), min_len=1, max_len=6, cut_long=True)
    assert disposition.trimmed(cut).first()["seq"] == "ACGTAC" and disposition.trimmed(cut, keep="tail").first()["seq"] == "ACGTAC"
    assert disposition.masked_reads(cut).first()["seq"] == "ACGTACgtac"
    assert disposition.dispose(df.where("name = 'n'"), min_len=1, max_len=6).first()["tag"] == "LONG"
    assert disposition.trimmed(cut, fill_n=True).first()["seq"] == "ACGTACNNNN"


def test_profiles(spark):
    df = spark.createDataFrame([("m:1:7:1", "ACGT", "ACGA", "IIBB"), ("m:1:8:1", "ACGT", "ACNT", "I!I!")], "name string, ref_seq string, seq string, qual string")
    calls = profile.base_calls(df)
    assert calls.agg(F.sum("n")).first()[0] == 7
    assert profile.mismatch_rates(calls).first()["mismatch_rate"] == pytest.approx(1 / 7)
    assert {(r["cycle"], r["n"]) for r in profile.quality_by_cycle(df, cut="B").collect()} == {(1, 2), (2, 2), (3, 1), (4, 1)}
    t = profile.transitions(df)
    assert t.agg(F.sum("n")).first()[0] == 6
    m = {r["prev_q"]: r for r in profile.transition_moments(t).collect()}
    assert m[40]["n"] == 4 and m[40]["low"] == 0 and m[40]["high"] == 40 and m[40]["mode"] == 0
    assert profile.merge_counts(t, t).agg(F.sum("n")).first()[0] == 12
    assert profile.tile_quality(df, prefixes=(1,)).count() == 4
    ind = spark.createDataFrame([("3M2I4M1D2M",), ("5M",)], "cigar string")
    assert {tuple(r) for r in profile.indels(ind).collect()} == {(3, 2, 1), (9, -1, 1)}
    w = spark.createDataFrame([("G" * 20 + "A" * 20, float(i)) for i in range(1, 6)] + [("N" * 40, 1.0)], "seq string, depth double")
    g = profile.gc_depth(w).collect()
    assert len(g) == 1 and (g[0]["gc"], g[0]["n"], g[0]["q2"]) == (50.5, 5, 3.0)
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(20)], "x double, y double")
    assert all(abs(r["smoothed"] - r["y"]) < 1e-6 for r in profile.loess(line, "x", "y", 3).collect())
    hist = spark.createDataFrame([(10, 1), (20, 3)], "size int, n int")
    assert profile.weighted_moments(hist).first()["mean"] == pytest.approx(17.5)
    assert profile.tiles(spark.createDataFrame([("c", "ACGTA")], "chrom string, seq string"), 2).count() == 3
    assert profile.best_kmer(spark.createDataFrame([("b", 2), ("a", 2)], "kmer string, cnt int")).first()["kmer"] == "a"
    assert profile.drop_short(df, 5, "seq").count() == 0


def test_ranges(spark):
    df = spark.createDataFrame([(i, f"{i % 3}|x") for i in range(10)], "id int, v string")
    assert sorted(x["count"] for x in ranges.segment(df, 4, "id").groupBy("segment").count().collect()) == [2, 2, 3, 3]
    assert ranges.to_map(df, "v", "id", "id").count() == 3 and ranges.split(df, "v", "|").count() == 20
    assert ranges.irange(spark, 2, 5).count() == 3
    got = ranges.at(ranges.indexed(df, "id"), spark.createDataFrame([(3,), (3,), (9,)], "ordinal long"))
    assert sorted(x["id"] for x in got.collect()) == [3, 3, 9]


def test_stream_trim(spark, tmp_path, write):
    folder = tmp_path / "in"
    folder.mkdir()
    r = random.Random(1)
    inserts = [dna(r, 30) for _ in range(20)]
    for k in range(2):
        (folder / f"{k}.fq").write_text("".join(f"@r{i}\n{s + ADAPTER1}\n+\n{'I' * (30 + len(ADAPTER1))}\n" for i, s in enumerate(inserts)))
    out = stream.stream_trim(stream.stream_fastq(spark, str(folder)), [ADAPTER1], min_len=10)
    q = stream.write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 40 and {x["seq"] for x in got.collect()} == set(inserts)


def test_command_line(spark, tmp_path, write):
    from readloom.__main__ import main

    r = random.Random(8)
    inserts = [dna(r, 40) for _ in range(30)]
    path = write("a.fq", "".join(f"@r{i}\n{s + ADAPTER1}\n+\n{'I' * 74}\n" for i, s in enumerate(inserts)))
    main(["known", "-1", path, "-o", str(tmp_path / "o"), "-a", ADAPTER1, "-m", "18"], spark)
    assert [x["seq"] for x in io.read_fastq(spark, str(tmp_path / "o")).orderBy("ordinal").collect()] == inserts
    assert np.isfinite(adapter.rc_score("ACGT", "IIII", "ACGT", "IIII", 4))
    mate = write("b.fq", "".join(f"@r{i}\n{rc(s) + ADAPTER2}\n+\n{'I' * 74}\n" for i, s in enumerate(inserts)))
    main(["paired", "-1", path, "-2", mate, "-o", str(tmp_path / "p"), "--gzip"], spark)
    assert [x["seq"] for x in io.read_fastq(spark, str(tmp_path / "p_2")).orderBy("ordinal").collect()] == [rc(s) for s in inserts]
    genome = write("g.fa", ">c\n" + "".join(inserts) + "\n")
    main(["build", "-r", genome, "-p", str(tmp_path / "idx"), "-d", "20"], spark)
    main(["single", "-1", path, "-p", str(tmp_path / "idx"), "-d", "20", "-o", str(tmp_path / "s"), "-u"], spark)
    assert io.read_fastq(spark, str(tmp_path / "s")).where("length(seq) = 40").count() == 30


def test_chunks_and_index_of_a_long_contig(spark):
    r = random.Random(21)
    text = "".join(r.choice("ACGT") for _ in range(300_000))
    text = text[:5000] + "NNN" + text[5003:]
    contigs = spark.createDataFrame([("c", text), ("d", text[:1500]), ("e", "")], "chrom string, seq string")
    rows = {(x["chrom"], x["chunk"]): (x["first"], x["text"]) for x in chunks.chunks(contigs, 1024, 256, 100).collect()}
    assert len(rows) == 293 + 2 + 1 and rows["e", 0] == (0, "")
    assert all(t == {"c": text, "d": text[:1500], "e": ""}[c][f : (k + 1) * 1024 + 100] and f == max(0, k * 1024 - 256) for (c, k), (f, t) in rows.items())
    index = seeds.build_index(contigs, 20)
    want = sum("N" not in text[i : i + 20] for i in range(300_000 - 19)) + 1500 - 19
    assert index.kmers.count() == want
    at = index.kmers.where("chrom = 'c' AND pos % 1024 IN (0, 1004, 1005, 1023)").collect()
    assert at and all(x["kmer"] == text[x["pos"] : x["pos"] + 20] for x in at)
    reads = spark.createDataFrame([(1, text[1000:1090] + "GGG"), (2, S_revcomp(text[2020:2100]))], "read_id long, seq string")
    got = {(x["read_id"], x["chrom"], x["pos"], x["strand"], x["prefix_len"] >= 80) for x in seeds.seed_loci(reads, index, allow_mismatch=False).collect()}
    assert got == {(1, "c", 1000, "+", True), (1, "d", 1000, "+", True), (2, "c", 2020, "-", True)}


def S_revcomp(text):
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_mismatch_tags(spark):
    from readloom.sources import alignments

    r = random.Random(22)
    c = "".join(r.choice("ACGT") for _ in range(400))
    swap = {"A": "C", "C": "G", "G": "T", "T": "A"}
    one = c[100:130] + swap[c[130]] + c[131:160]
    two = S_revcomp(c[200:260])
    two = two[:40] + swap[two[40]] + two[41:]
    reads = spark.createDataFrame([(1, "a", one, "I" * 60), (2, "b", two, "I" * 60)], "read_id long, name string, seq string, qual string")
    rows = seeds.seed_loci(reads, seeds.build_index(spark.createDataFrame([("c", c)], "chrom string, seq string"), 18)).join(reads, "read_id")
    got = {x["qname"]: (x["pos"], x["cigar"], {t["tag"]: t["value"] for t in x["tags"]}) for x in alignments.aligned_sam(rows).collect()}
    assert got == {"a": (101, "60M", {"NH": "1", "MD": f"30{c[130]}29"}), "b": (201, "60M", {"NH": "1", "MD": f"19{c[219]}40"})}


def test_hits_and_joint_pairs_match_brute_force():
    r = random.Random(23)
    ad = "AGATCGGAAGAGCACACG"
    reads, quals = [], []
    for _ in range(60):
        n = r.randint(0, 50)
        t = dna(r, n) + ad[: r.randint(0, 18)] + dna(r, r.randint(0, 10))
        reads.append("".join(r.choice("ACGT") if r.random() < 0.05 else c for c in t) or "A")
        quals.append("".join(r.choice("#5:I") for _ in reads[-1]))
    cost = lambda q: 0.477 if q <= 0 else 4.477 if q > 39 else 0.477 + q / 10
    got = {}
    for k, i, at, score in zip(*adapter.hits(reads, quals, [ad], 0.15, delta=0.0)):
        got[int(k), int(at)] = (int(i), round(float(score), 6))
    want = {}
    for k, (t, q) in enumerate(zip(reads, quals)):
        for at in range(len(t)):
            m = min(len(ad), len(t) - at)
            c = sum(cost(ord(q[at + x]) - 33) for x in range(m) if t[at + x] != ad[x])
            if m >= min(adapter.default_overlap(0.15), len(ad) + 1) and c < 0.15 * 2.477 * m + 0.001:
                want[k, at] = (0, round(2.477 * m - c, 6))
    assert got == want and len(want) > 30
    pairs, truth = [], []
    for _ in range(80):
        frag = dna(r, r.randint(0, 45))
        a, b = (frag + ad + dna(r, 40))[:40], (rc(frag) + ad + dna(r, 40))[:40]
        pairs.append((a, "I" * 40, b, "I" * 40))
        truth.append(min(len(frag), 40))
    out = adapter.pair_scan(*map(list, zip(*pairs)), [ad], [ad])
    assert all(x[0] == t for x, t in zip(out, truth) if t <= 36) and sum(t <= 36 for t in truth) > 40
    none = adapter.pair_scan(*map(list, zip(*pairs)), [ad], [ad], allowed=set())
    assert all(n == (40, -1, -1) for n, x in zip(none, out) if x[1] >= 0 and x[2] >= 0)


def test_joins_of_seeds_are_never_broadcast(spark):
    """The planner takes k-mers for as small as the contigs' file; broadcast, they take the driver's memory."""
    r = random.Random(5)
    contigs = [dna(r, 200) for _ in range(3)]
    table = seeds.build_index(spark.createDataFrame([(f"c{i}", c) for i, c in enumerate(contigs)], "chrom string, seq string"), 12)
    reads = spark.createDataFrame([(i, contigs[i % 3][i : i + 40]) for i in range(30)], "read_id long, seq string")
    for rows in (seeds.seed_align(reads, table), seeds.seed_loci(reads, table), seeds.seed_mismatch(reads, table)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_counts_of_overlaps_without_pairs(spark):
    r = random.Random(21)
    def some(n, far):
        rows = [(i, r.choice(["a", "b", "only" + str(far), None]), b := r.randrange(9_000), b + r.choice([-3, 0, 1, 40, far]), r.choice(["x", "y", None]), i % 7 + 1) for i in range(n)]
        return rows, spark.createDataFrame(rows, "id long, chrom string, begin long, stop long, gene_type string, reads long")

    (q, qs), (d, ds) = some(150, 6_000), some(200, 5_000)
    hit = lambda a, b: a[1] is not None and a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and a[3] >= b[2]
    want = {a[0]: (sum(hit(a, b) for b in d), sum(b[5] / 3 for b in d if hit(a, b))) for a in q}
    got = {x["id"]: (x["hits"], x["total"]) for x in intervals.overlap_sums(qs, ds, F.col("reads") / 3).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    marked = intervals.mark_filtered(intervals.annotate(qs, ds), ("x",))
    assert sorted(intervals.filtered(qs, ds, ("x",)).select("id", "is_filtered").collect()) == sorted(marked.select("id", "is_filtered").collect())
    old = {x["gene_type"]: x["reads"] for x in intervals.annotation_stats(intervals.annotate(qs, ds)).collect()}
    new = {x["gene_type"]: x["reads"] for x in intervals.fractional_counts(qs, ds).collect()}
    assert old.keys() == new.keys() and all(abs(old[k] - new[k]) < 1e-9 for k in old)
    runs = set()
    for a in q:
        points = {a[2], a[3]} | {p for b in d if hit(a, b) for p in (max(a[2], b[2]), min(a[3], b[3]))}
        for x, y in zip(sorted(points), sorted(points)[1:]):
            runs.add((a[0], a[1], x, y, sum(hit(a, b) and b[2] <= x < b[3] for b in d)))
    rows = [tuple(x) for x in intervals.coverage(qs, ds).collect()]
    assert len(rows) == len(runs) and set(rows) == runs
    assert intervals.overlap_sums(qs, ds.limit(0)).agg(F.sum("hits")).first()[0] == 0
    # 1.6e9 pairs
    many = spark.range(40_000).select("id", F.lit("a").alias("chrom"), (F.col("id") % 10).alias("begin"), (F.col("id") % 10 + 50).alias("stop"))
    assert intervals.overlap_sums(many, many).agg(F.sum("hits")).first()[0] == 40_000**2
    assert intervals.coverage(many, many).where("depth < 4000 OR depth > 40000").count() == 0

"""Seed-and-tail alignment against a k-mer table instead of a suffix index.

The table holds the forward k-mers of the reference with their places; reads probe it with their first
k bases and with the reverse complement, so one strand is enough. Up to ``NUMERIC`` bases, k-mers are numbers:
those of reads and reference with an equal half meet in one part, where one base of the other half may differ;
few reads go to all tasks that read the reference instead. Places are extended in an Arrow pass
against short overlapping chunks of the reference. No task holds a genome.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..storage import stored
from .chunks import chunks

#: Longer reads are extended over several chunks.
MAX_READ = 256
CHUNK = 1024
#: k-mers of so many bases or fewer are looked up as numbers of two bits a base, longer ones as texts.
NUMERIC = 31
#: So many reads or fewer go to every task that reads the reference.
FEW = 50_000
#: k-mers of a part, of a table made at once, and pairs given out at once.
PART, TABLE, PAIRS = 1 << 20, 1 << 20, 1 << 20


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: k-mers and places are many times what the planner takes from the contigs' file."""
    return df.hint("merge")


@dataclass
class SeedIndex:
    """``kmers`` (kmer, chrom, pos) and ``chunks`` (chrom, chunk, first, text), the reference in overlapping parts."""

    k: int
    kmers: DataFrame
    chunks: DataFrame


def build_index(contigs: DataFrame, k: int) -> SeedIndex:
    """Every forward k-mer without N, with its place. Lower-case bases count as upper case.

    Contigs are cut into chunks first: time and memory grow with their bases, and one contig is work for many tasks.
    """
    if not 0 < k <= MAX_READ:
        raise ValueError(f"k is from 1 to {MAX_READ}")
    parts = chunks(contigs.select("chrom", F.upper("seq").alias("seq")).where(F.length("seq") >= k), CHUNK, MAX_READ, MAX_READ)
    begin = F.col("chunk") * CHUNK
    n = F.least(F.lit(CHUNK), F.length("text") - (begin - F.col("first")) - k + 1).cast("int")
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((begin + i).alias("pos"), F.substring(F.col("text"), (begin - F.col("first")).cast("int") + i + 1, F.lit(k)).alias("kmer")))
    rows = parts.where(n > 0).select("chrom", F.explode(at).alias("x")).select("x.kmer", "chrom", "x.pos")
    return SeedIndex(k, rows.where(~F.col("kmer").rlike("[^ACGT]")), parts)


def save_index(index: SeedIndex, path: str) -> None:
    """k-mers in order of their hash partition, chunks, and what they were made for."""
    index.kmers.repartition("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/kmers")
    index.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    index.kmers.sparkSession.createDataFrame([(index.k, 1)], "k int, version int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_index(spark, path: str, k: int | None = None) -> SeedIndex:
    """The stored index; an error if it was made for another k."""
    meta = spark.read.schema("k int, version int").json(f"{path}/meta").first()
    if meta is None or (k is not None and meta["k"] != k):
        raise ValueError(f"index at {path} is missing or was not built for k = {k}")
    return SeedIndex(meta["k"], spark.read.parquet(f"{path}/kmers"), spark.read.parquet(f"{path}/chunks"))


def _prefix(a: bytes, b: bytes, at: int = 0) -> int:
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n)[at:] != np.frombuffer(b, np.uint8, n)[at:]
    return at + (int(x.argmax()) if x.any() else n - at)


def _extend(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["read_id", "strand", "chrom", "pos", "mm", "m", "alt", "m2", "seq"]
    for b in batches:
        col = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names)}
        rows = []
        for read_id, strand, chrom, pos, probe, window in zip(*(col[c] for c in ("read_id", "strand", "chrom", "pos", "seq", "window"))):
            read, ref = probe.encode(), window.encode()
            m = _prefix(read, ref)
            alt, m2 = None, m
            if m < k:  # the substituted base of the seed; never the read's last one
                if m + 1 < len(read):
                    m2 = _prefix(read, ref, m + 1)
                    rows.append((read_id, strand, chrom, pos, m, m2, chr(ref[m]), m2, probe))
                continue
            if len(read) - m >= 3 and m < len(ref):
                far = _prefix(read, ref, m + 1)
                if far > m + 1:
                    alt, m2 = chr(ref[m]), far
            rows.append((read_id, strand, chrom, pos, -1, m, alt, m2, probe))
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 9, types)], names)


_HIT = "read_id long, strand string, chrom string, pos long, mm int, m int, alt string, m2 int, seq string"


def _long_windows(found: DataFrame, index: SeedIndex) -> DataFrame:
    """The windows of reads over ``MAX_READ``, put together from all chunks they lie in."""
    k, names = index.k, ["read_id", "strand", "chrom", "pos", "seq"]
    begin = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.greatest(F.col("pos") + k - F.length("seq"), F.lit(0)))
    stop = F.when(F.col("strand") == "+", F.col("pos") + F.length("seq")).otherwise(F.col("pos") + k)
    rows = found.select(*names, begin.alias("begin"), stop.alias("stop"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("begin") / CHUNK), F.floor((F.col("stop") - 1) / CHUNK))))
    core = index.chunks.select("chrom", "chunk", F.expr(f"substring(text, int(chunk * {CHUNK} - first) + 1, {CHUNK})").alias("core"))
    rows = rows.join(_shuffled(core), ["chrom", "chunk"]).groupBy(*names, "begin", "stop").agg(F.sort_array(F.collect_list(F.struct("chunk", "core"))).alias("parts"))
    window = F.expr(f"substring(array_join(transform(parts, x -> x.core), ''), int(begin % {CHUNK}) + 1, int(stop - begin))")
    return rows.select(*names, F.when(F.col("strand") == "+", window).otherwise(S.revcomp(window)).alias("window"))


def _one_off(probes: DataFrame, index: SeedIndex) -> DataFrame:
    """``probes`` with the places (chrom, pos) of k-mers that differ from their ``kmer`` in exactly one base.

    One of both halves is exact (pigeonhole), and never both, so each half is an equi-join and finds a place once.
    """
    k, out = index.k, None
    half = k // 2
    for begin, size in ((1, half), (half + 1, k - half)):
        exact, rest = (lambda c: F.substring(c, begin, size)), (lambda c: F.substring(c, half + 1, k - half) if begin == 1 else F.substring(c, 1, half))  # noqa: B023
        t = index.kmers.select(exact("kmer").alias("h"), rest("kmer").alias("rest__"), "chrom", F.col("pos").cast("long").alias("pos"))
        pairs = probes.withColumns({"h": exact("kmer"), "own__": rest("kmer")}).join(_shuffled(t), "h").where(F.levenshtein("own__", "rest__", 1) == 1)
        pairs = pairs.select(*probes.columns, "chrom", "pos")
        out = pairs if out is None else out.unionByName(pairs)
    return out


_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: Bits of a probe above its k-mer: the reverse strand, and no base to be substituted.
_REVERSE, _EXACT = np.uint64(1 << 63), np.uint64(1 << 62)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a column of texts without nulls, and where each begins and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), begin


def _reference(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of chunks (first two columns: chunk, first; last: text) slices with their k-mers, each one's row and its place in the chunk."""
    for b in batches:
        text, at = _bytes(b.column(b.num_columns - 1))
        skip = b.column(0).to_numpy() * CHUNK - b.column(1).to_numpy()
        n = np.clip(np.minimum(CHUNK, np.diff(at) - skip - k + 1), 0, None)
        cuts = np.searchsorted(n.cumsum(), np.arange(0, max(int(n.sum()), 1), TABLE), "left")
        for lo, hi in zip(cuts, [*cuts[1:], len(n)]):
            if lo == hi or not n[lo:hi].sum():
                continue
            codes = _CODE[text[at[lo] : at[hi]]]
            size = len(codes) - k + 1
            v = np.zeros(size, np.uint64)
            for j in range(k):
                v = (v << np.uint64(2)) | (codes[j : j + size] & 3)
            bad = np.r_[0, (codes > 3).cumsum()]
            row = np.repeat(np.arange(hi - lo), n[lo:hi])
            off = np.arange(len(row)) - np.repeat(n[lo:hi].cumsum() - n[lo:hi], n[lo:hi])
            start = (at[lo:hi] - at[lo] + skip[lo:hi])[row] + off
            good = bad[start + k] == bad[start]
            yield b.slice(lo, hi - lo), v[start[good]], row[good], off[good]


def _probes(ids: np.ndarray, seqs: pa.Array, k: int, mismatch: bool) -> tuple[np.ndarray, np.ndarray]:
    """k-mers of both strands, with bits for strand and kind, and their reads.

    With ``mismatch``, first k bases with one character besides ACGT are four probes with each base in its place, looked up as they are.
    """
    text, at = _bytes(seqs)
    codes = _CODE[text[at[:-1, None] + np.arange(k)]] if len(ids) else np.zeros((0, k), np.uint8)
    odd = (codes > 3).sum(axis=1)
    one = codes[odd == 1]
    where = (one > 3).argmax(axis=1) if len(one) else np.zeros(0, int)
    sets = [(ids[odd == 0], codes[odd == 0], np.uint64(0))]
    for base in range(4 if mismatch else 0):
        each = one.copy()
        each[np.arange(len(one)), where] = base
        sets.append((ids[odd == 1], each, _EXACT))
    kmers, own = [], []
    for who, c, flag in sets:
        forward, reverse = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
        for j in range(k):
            forward = (forward << np.uint64(2)) | c[:, j]
            reverse = (reverse << np.uint64(2)) | (3 - c[:, k - 1 - j])
        kmers += [forward | flag, reverse | flag | _REVERSE]
        own += [who, who]
    return np.concatenate(kmers), np.concatenate(own)


class _Table:
    """k-mers of the reference in order, with a bitmap that most others fail."""

    def __init__(self, kmers: np.ndarray, places: np.ndarray, k: int):
        order = kmers.argsort(kind="stable")
        self.k, self.kmers, self.places = k, kmers[order], places[order]
        self.shift = np.uint64(64 - max(10, min(24, len(kmers).bit_length() + 3)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.kmers * _MIX) >> self.shift] = True

    def _at(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``kmers`` are here, and the range of each."""
        some = np.flatnonzero(self.seen[(kmers * _MIX) >> self.shift])
        lo = np.searchsorted(self.kmers, kmers[some], "left")
        here = self.kmers[np.minimum(lo, len(self.kmers) - 1)] == kmers[some]
        some, lo = some[here], lo[here]
        return some, lo, np.searchsorted(self.kmers, kmers[some], "right")

    def pairs(self, probes: np.ndarray, bases: range, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(probe, place, exact): equal k-mers if ``exact``, and those with one of ``bases`` (from the right) substituted,
        for probes without an equal one here."""
        plain = probes & ~(_REVERSE | _EXACT)
        some, lo, hi = self._at(plain)
        if exact:
            yield from ((i, at, True) for i, at in self._spread(some, lo, hi))
        if not len(bases):
            return
        open_ = (probes & _EXACT) == 0
        open_[some] = False
        left = np.flatnonzero(open_)
        masks = np.array([x << (2 * j) for j in bases for x in (1, 2, 3)], np.uint64)
        step = max(1, 2 * PAIRS // len(masks))
        for a in range(0, len(left), step):
            own = left[a : a + step]
            i, lo, hi = self._at((plain[own, None] ^ masks).ravel())
            yield from ((x, at, False) for x, at in self._spread(own[i // len(masks)], lo, hi))

    def _spread(self, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = (hi - lo).cumsum()
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + PAIRS, "right")))
            size = (hi - lo)[a:b]
            at = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + np.repeat(lo[a:b], size)
            yield np.repeat(i[a:b], size), self.places[at]
            a = b


def _strands(probes: np.ndarray) -> pa.Array:
    return pa.array(np.where((probes & _REVERSE) != 0, "-", "+"))


def _few(usable: DataFrame, index: SeedIndex, mismatch: bool) -> DataFrame:
    """(read_id, strand, chrom, pos) of few reads: their probes go to the tasks that read the reference."""
    spark, k = usable.sparkSession, index.k
    rows = usable.select("read_id", F.substring("seq", 1, k).alias("seq")).toArrow().combine_chunks()
    probes, ids = _probes(rows["read_id"].to_numpy(), rows["seq"].combine_chunks(), k, mismatch)
    shared = spark.sparkContext.broadcast((probes, ids))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, ids = shared.value
        for b, kmers, row, off in _reference(batches, k):
            pos = (b.column(0).to_numpy() * CHUNK)[row] + off
            if not len(kmers):
                continue
            table = _Table(kmers, np.arange(len(kmers)), k)
            for i, at, exact in table.pairs(probes, range(k if mismatch else 0), True):
                columns = [ids[i], _strands(probes[i]), b.column(2).take(pa.array(row[at])), pos[at], np.full(len(i), exact)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["read_id", "strand", "chrom", "pos", "exact"])

    found = index.chunks.select("chunk", "first", "chrom", "text").mapInArrow(look, "read_id long, strand string, chrom string, pos long, exact boolean")
    # an equal k-mer may lie in another table; _EXACT probes have one substituted and no equal one besides
    found = found.withColumn("any", F.max("exact").over(Window.partitionBy("read_id", "strand"))).where("exact OR NOT any")
    return found.select("read_id", "strand", "chrom", "pos")


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress where numbers are small or in order."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(x: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


_PACKED = ["part", "side", "kmers", "of"]


def _packed(kmers: np.ndarray, of: np.ndarray, side: int, half: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row a part: its k-mers in order, and the numbers that belong to them."""
    part = ((half * _MIX) >> np.uint64(32)) % np.uint64(parts)
    order = np.lexsort((kmers, part))
    kmers, of, part = kmers[order], of[order], part[order]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = [*cut[1:], len(part)]
    columns = [pa.array(part[cut].astype(np.int32)), pa.array([side] * len(cut), pa.int32())]
    columns += [pa.array([_planes(x[a:b]) for a, b in zip(cut, ends)], pa.binary()) for x in (kmers, of.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, _PACKED)


def _many(usable: DataFrame, index: SeedIndex, mismatch: bool) -> DataFrame:
    """(read_id, strand, chrom, pos, first, text): reads and reference meet by equal halves of k-mers.

    With one base substituted the other half is exact, and both are not, so a place is found once.
    """
    k, spark = index.k, usable.sparkSession
    own = stored(index.chunks.select("chunk", "first", F.monotonically_increasing_id().alias("id__"), "chrom", "text"), "chunks")
    n = own.agg(F.sum(F.least(F.lit(CHUNK), F.length("text")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART))
    half = k // 2 if mismatch else k
    low, schema, found = k - half, "part int, side int, kmers binary, of binary", None
    for first in (True, False) if mismatch else (True,):
        key = (lambda x: x >> np.uint64(2 * low)) if first else (lambda x: x & np.uint64((1 << 2 * low) - 1))  # noqa: B023
        bases = range(low) if first else range(low, k)

        def reference(batches, key=key):
            for b, kmers, row, off in _reference(batches, k):
                if len(kmers):
                    yield _packed(kmers, b.column(2).to_numpy()[row] * CHUNK + off, 0, key(kmers), parts)

        def reads(batches, key=key, first=first):
            waiting, size = [], 0
            for b in batches:
                kmers, of = _probes(b.column(0).to_numpy(), b.column(1), k, mismatch)
                if not first:  # looked up as they are before
                    free = (kmers & _EXACT) == 0
                    kmers, of = kmers[free], of[free]
                waiting.append((kmers, of))
                size += len(kmers)
                if size >= TABLE:
                    yield from pack(waiting, key)
                    waiting, size = [], 0
            yield from pack(waiting, key)

        def pack(waiting, key):
            if sum(len(x) for x, _ in waiting):
                kmers, of = (np.concatenate(x) for x in zip(*waiting))
                yield _packed(kmers, of, 1, key(kmers & ~(_REVERSE | _EXACT)), parts)

        def look(batches, first=first, bases=bases):
            part, held, table = None, [], None
            for b in batches:
                for p, side, kmers, of in zip(*(c.to_pylist() for c in b.columns)):
                    if p != part:
                        part, held, table = p, [], None
                    kmers, of = _numbers(kmers, np.uint64), _numbers(of, np.int64)
                    if side == 0:
                        held.append((kmers, of))
                        continue
                    if not held:
                        continue
                    if table is None:
                        table = _Table(*(np.concatenate(x) for x in zip(*held)), k)
                    for i, at, _ in table.pairs(kmers, bases, first):
                        yield pa.RecordBatch.from_arrays([pa.array(of[i]), _strands(kmers[i]), pa.array(at)], ["read_id", "strand", "at"])

        rows = own.select("chunk", "first", "id__", "text").mapInArrow(reference, schema)
        rows = rows.unionByName(usable.select("read_id", F.substring("seq", 1, k).alias("seq")).mapInArrow(reads, schema))
        rows = rows.repartition(parts, "part").sortWithinPartitions("part", "side")
        rows = stored(rows.mapInArrow(look, "read_id long, strand string, at long"), "places")
        found = rows if found is None else found.unionByName(rows)
    found = found.withColumn("id__", F.floor(F.col("at") / CHUNK) if CHUNK & (CHUNK - 1) else F.shiftright("at", CHUNK.bit_length() - 1))
    found = found.join(_shuffled(own), "id__")
    return found.select("read_id", "strand", "chrom", (F.col("chunk") * CHUNK + F.col("at") % CHUNK).alias("pos"), "first", "text")


def _by_text(usable: DataFrame, index: SeedIndex, mismatch: bool) -> DataFrame:
    """(read_id, strand, chrom, pos) for k-mers of any length: equi-joins on texts."""
    forward = usable.select("read_id", F.lit("+").alias("strand"), F.substring("seq", 1, index.k).alias("kmer"))
    reverse = forward.select("read_id", F.lit("-").alias("strand"), S.revcomp("kmer").alias("kmer"))
    both = forward.unionByName(reverse)
    found = both.join(_shuffled(index.kmers), "kmer").drop("kmer")
    if mismatch:
        bare = both.join(_shuffled(index.kmers.select("kmer")), "kmer", "left_anti")
        found = found.unionByName(_one_off(bare, index).drop("kmer"))
    return found


def hits(reads: DataFrame, index: SeedIndex, mismatch: bool = False) -> DataFrame:
    """Every place of every read's first k bases, extended: exact prefix ``m``, and beyond one mismatch ``m2``.

    With ``mismatch``, first bases without a place on a strand are also looked up with each one substituted:
    ``mm`` is that base (else -1), ``m`` and ``m2`` the prefix with it. ``seq`` is the read.
    """
    k = index.k
    usable = reads.select(F.col("read_id").cast("long").alias("read_id"), F.upper("seq").alias("seq")).where((F.length("seq") >= k) & ~F.col("seq").contains("N"))
    usable = stored(usable, "reads")
    n, longest = usable.agg(F.count("*"), F.max(F.length("seq"))).first()
    found = (_by_text if k > NUMERIC else _few if n <= FEW else _many)(usable, index, mismatch)
    if "text" not in found.columns:
        found = found.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(_shuffled(index.chunks), ["chrom", "chunk"])
    ahead = F.expr(f"substring(text, int(pos - first) + 1, {MAX_READ})")
    behind = F.expr(f"substring(text, int(greatest(pos + {k} - {MAX_READ}, first) - first) + 1, int(pos + {k} - greatest(pos + {k} - {MAX_READ}, first)))")
    window = F.when(F.col("strand") == "+", ahead).otherwise(S.revcomp(behind))
    found = found.select("read_id", "strand", "chrom", "pos", window.alias("window")).join(_shuffled(usable), "read_id")
    rows = found.where(F.length("seq") <= MAX_READ).select("read_id", "strand", "chrom", "pos", "seq", "window")
    if (longest or 0) > MAX_READ:
        rows = rows.unionByName(_long_windows(found.where(F.length("seq") > MAX_READ).drop("window"), index))
    return rows.mapInArrow(lambda batches: _extend(batches, k), _HIT)


def seed_align(reads: DataFrame, index: SeedIndex, max_align: int = 0, allow_mismatch: bool = True) -> DataFrame:
    """(read_id, strand, prefix_len, mismatch_at, alt, tail, n_loci): the longest prefix on each strand.

    The prefix is exact; with ``allow_mismatch`` one mismatch after it, or inside the first k bases of
    reads without an exact place, is passed if a base behind it matches again, each other base giving a
    record of its own. Fully matching reads have an empty tail.
    ``max_align`` > 0 drops reads with more places than that.
    """
    rows = _places(reads, index, allow_mismatch)
    rows = rows.groupBy("read_id", "strand", "mismatch_at", "alt", "prefix_len").agg(F.count("*").alias("n_loci"), F.first("seq").alias("seq"))
    return _finished(rows, max_align, "n_loci").select("read_id", "strand", "prefix_len", "mismatch_at", "alt", "tail", "n_loci")


def seed_loci(reads: DataFrame, index: SeedIndex, max_align: int = 0, allow_mismatch: bool = True) -> DataFrame:
    """The records of ``seed_align``, one row for each place: ``chrom`` and ``pos`` (leftmost, 0-based) are added.

    ``n_loci`` counts the places of the record. With ``name``, ``qual`` and ``seq`` of the reads joined, the rows
    are what SAM and BED output take.
    """
    rows = _places(reads, index, allow_mismatch)
    key = ["read_id", "strand", "mismatch_at", "alt", "prefix_len"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n_loci"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    each = rows.alias("a").join(_shuffled(counts.alias("b")), (F.col("a.read_id") == F.col("b.read_id")) & same[1] & same[2] & same[3] & same[4]).select("a.*", "b.n_loci")
    pos = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") + index.k - F.col("prefix_len"))
    each = _finished(each.withColumn("pos", pos), max_align, "1")
    return each.select("read_id", "strand", "prefix_len", "mismatch_at", "alt", "tail", "n_loci", "chrom", "pos")


def _places(reads: DataFrame, index: SeedIndex, allow_mismatch: bool) -> DataFrame:
    """(read_id, strand, mismatch_at, alt, prefix_len, chrom, pos, seq): places of the records; ``pos`` is the seed's."""
    found = stored(hits(reads, index, allow_mismatch), "hits")  # read three times
    names = ["read_id", "strand", "mismatch_at", "alt", "prefix_len", "chrom", "pos", "seq"]
    inside, found = found.where("mm >= 0"), found.where("mm < 0")
    top = Window.partitionBy("read_id", "strand")
    at = found.withColumn("top", F.max("m").over(top)).where("m = top")
    if not allow_mismatch:
        return at.select("read_id", "strand", F.lit(None).cast("int").alias("mismatch_at"), F.lit(None).cast("string").alias("alt"), F.col("m").alias("prefix_len"), "chrom", "pos", "seq")
    # a place that passes a mismatch stands for its read and strand, by other base the farthest ones
    at = at.withColumn("far", F.max("m2").over(Window.partitionBy("read_id", "strand", "alt"))).withColumn("any", F.max(F.col("alt").isNotNull()).over(top))
    passed = at.where("alt IS NOT NULL AND m2 = far").select("read_id", "strand", F.col("m").alias("mismatch_at"), "alt", F.col("far").alias("prefix_len"), "chrom", "pos", "seq")
    whole = at.where("NOT any").select("read_id", "strand", F.lit(None).cast("int").alias("mismatch_at"), F.lit(None).cast("string").alias("alt"), F.col("m").alias("prefix_len"), "chrom", "pos", "seq")
    # of places with a base of the seed substituted those with the shortest tail
    best = inside.withColumn("top", F.max("m").over(top)).where("m = top")
    best = best.select("read_id", "strand", F.col("mm").alias("mismatch_at"), "alt", F.col("m").alias("prefix_len"), "chrom", "pos", "seq")
    return whole.select(names).unionByName(passed.select(names)).unionByName(best.select(names))


def _finished(rows: DataFrame, max_align: int, weight: str) -> DataFrame:
    """``rows`` with ``tail``, without reads of more than ``max_align`` places."""
    rows = rows.withColumn("tail", F.expr("substring(seq, prefix_len + 1)")).drop("seq")
    if max_align > 0:
        many = rows.groupBy("read_id").agg(F.sum(F.expr(weight)).alias("t")).where(F.col("t") > max_align)
        rows = rows.join(_shuffled(many), "read_id", "left_anti")
    return rows


def seed_mismatch(reads: DataFrame, index: SeedIndex) -> DataFrame:
    """(read_id, chrom, pos): forward places whose first k bases differ in exactly one, by halves.

    One of both halves is exact (pigeonhole), so each half is an equi-join; the rest is verified.
    """
    k = index.k
    usable = reads.select("read_id", F.upper("seq").alias("seq")).where((F.length("seq") >= k) & ~F.col("seq").contains("N"))
    out = _one_off(usable.select("read_id", F.substring("seq", 1, k).alias("kmer")), index)
    return out.select("read_id", "chrom", F.col("pos").cast("long").alias("pos")).distinct()


def shortest_tail(rows: DataFrame) -> DataFrame:
    """Rows of each read with its shortest tail."""
    least = rows.groupBy("read_id").agg(F.min(F.length("tail")).alias("t__"))
    return rows.join(_shuffled(least), "read_id").where(F.length("tail") == F.col("t__")).drop("t__")


def merged(rows: DataFrame) -> DataFrame:
    """One row of each read: the shortest tail, on ties the forward strand."""
    order = F.struct(F.length("tail").alias("t"), (F.col("strand") == "-").alias("s"), F.coalesce("alt", F.lit("")).alias("a"))
    pick = F.min_by(F.struct("strand", "prefix_len", "tail"), order)
    return rows.groupBy("read_id").agg(pick.alias("b")).select("read_id", "b.*")


def sample(reads: DataFrame, n: int, ordinal: str = "read_id") -> DataFrame:
    """The first ``n`` reads by ordinal; the last one's is found first, so only these reads are sorted whole."""
    last = reads.select(ordinal).orderBy(ordinal).limit(n).agg(F.max(ordinal)).first()[0]
    if last is not None:
        reads = reads.where(F.col(ordinal).isNull() | (F.col(ordinal) <= last))
    return reads.orderBy(ordinal).limit(n)

"""Mate overlap of paired reads: insert length from the reverse complement of the other mate.

``insert_len_expr`` is plain column expressions; ``insert_len`` is the same rule over Arrow batches
with numpy, all reads of a batch at once, and is what the plans use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

FLANK = 16
_COMP = np.arange(256, dtype=np.uint8)
for _a, _b in ("AT", "CG", "GC", "TA"):
    _COMP[ord(_a)] = ord(_b)


def cut_pair(pairs: DataFrame, r1: str = "r1", r2: str = "r2") -> DataFrame:
    """Both mates (and qualities, if any) cut to the shorter one."""
    n = F.least(F.length(r1), F.length(r2))
    names = {c: F.substring(F.col(c), F.lit(1), n) for c in (r1, r2, "q1", "q2") if c in pairs.columns}
    return pairs.withColumn("n__", n).withColumns({c: F.substring(F.col(c), F.lit(1), F.col("n__")) for c in names}).drop("n__")


def insert_len_expr(r1: str = "r1", r2: str = "r2", match: int = 70, seq: int = 90) -> Column:
    """Longest accepted insert of at least 16 bases, else the read length. Rates are percents."""
    a, b = F.col(r1), F.col(r2)
    n = F.least(F.length(a), F.length(b))
    rate = lambda x, y, size, pct: S.match_count(x, y) * 100 >= size * pct

    def ok(size):
        w1 = rate(F.substring(a, size - FLANK + 1, F.lit(FLANK)), S.revcomp(F.substring(b, 1, FLANK)), F.lit(FLANK), match)
        w2 = rate(F.substring(b, size - FLANK + 1, F.lit(FLANK)), S.revcomp(F.substring(a, 1, FLANK)), F.lit(FLANK), match)
        whole = rate(F.substring(a, F.lit(1), size), S.revcomp(F.substring(b, F.lit(1), size)), size, seq)
        return w1 & w2 & whole

    sizes = F.when(n >= FLANK, F.sequence(F.lit(FLANK), n)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, ok)), n)


def _matrix(texts: list[str], width: int) -> np.ndarray:
    data = "".join(texts).encode("latin-1", "replace")
    return np.frombuffer(data, np.uint8).reshape(len(texts), width)


def scan(r1: list[str], r2: list[str], adapters: tuple[str, str] | None = None, match: int = 70, seq: int = 90, adapter: int = 80, short_rule: bool = False) -> np.ndarray:
    """Insert length of each pair; with ``adapters`` the stricter trimming pass.

    The trimming pass skips inserts of full length and asks that what follows the insert matches
    either adapter; where no candidate insert exists at all it looks for the adapters in the first 16
    offsets. ``short_rule`` keeps the weaker candidate rule for reads under 64 bases: 16 offsets,
    recorded without the flank, and a strict threshold.
    """
    size = np.array([min(len(a), len(b)) for a, b in zip(r1, r2)], np.int64)
    out = size.copy()
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        if n < FLANK:
            continue
        a = _matrix([r1[i][:n] for i in rows], n)
        b = _matrix([r2[i][:n] for i in rows], n)
        n_a, n_b = a != ord("N"), b != ord("N")
        rc_a, rc_b = _COMP[a[:, ::-1]], _COMP[b[:, ::-1]]
        best, tried, open_ = np.full(len(rows), n), np.zeros(len(rows), bool), np.ones(len(rows), bool)
        short = short_rule and n < 64
        for end in range(n, FLANK - 1, -1):
            i = end - FLANK
            if short and i >= FLANK:
                continue
            w1 = ((a[:, i:end] == rc_b[:, n - FLANK :]) & n_a[:, i:end]).sum(1) * 100
            w2 = ((b[:, i:end] == rc_a[:, n - FLANK :]) & n_b[:, i:end]).sum(1) * 100
            may = (w1 > FLANK * match) & (w2 > FLANK * match) if short else (w1 >= FLANK * match) & (w2 >= FLANK * match)
            tried |= may
            length = i if short else end
            k = np.flatnonzero(may & open_)
            if not len(k) or not length or (adapters and length == n):
                continue
            same = ((a[k, :length] == rc_b[k, n - length :]) & n_a[k, :length]).sum(1) * 100 >= length * seq
            if adapters:
                hit = np.zeros(len(k), bool)
                for reads, text in ((a, adapters[0]), (b, adapters[1])):
                    m = min(len(text), n - length)
                    if m:
                        hit |= (reads[k, length : length + m] == np.frombuffer(text[:m].encode(), np.uint8)).sum(1) * 100 >= m * adapter
                same &= hit
            best[k[same]] = length
            open_[k[same]] = False
        if adapters:
            left = np.flatnonzero(~tried)
            for reads, text in ((a, adapters[0]), (b, adapters[1])):
                for at in range(FLANK):
                    m = min(FLANK, len(text), n - at)
                    if m < 5 or not len(left):
                        break
                    hit = (reads[left, at : at + m] == np.frombuffer(text[:m].encode(), np.uint8)).sum(1) * 100 > m * adapter
                    best[left[hit]] = at
                    left = left[~hit]
        out[rows] = best
    return out


def insert_len(r1: str = "r1", r2: str = "r2", adapters: tuple[str, str] | None = None, **rates) -> Column:
    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series(scan(x.fillna("").tolist(), y.fillna("").tolist(), adapters, **rates).astype("int32"))

    return run(F.col(r1), F.col(r2))


def trim_pairs(pairs: DataFrame, adapters: tuple[str, str], min_length: int = 0, **rates) -> DataFrame:
    """Pairs cut to one length, trimmed to the insert; pairs left with under ``min_length`` go."""
    cut = cut_pair(pairs).withColumn("pos", insert_len("r1", "r2", adapters, **rates))
    rows = cut.where(F.col("pos") >= min_length)
    return rows.withColumns({c: F.substring(F.col(c), F.lit(1), F.col("pos")) for c in ("r1", "r2", "q1", "q2") if c in pairs.columns})


def tails(pairs: DataFrame, **rates) -> DataFrame:
    """(tail1, tail2) after the insert of each pair whose mates read through it: the detection pass."""
    rows = cut_pair(pairs).withColumn("pos", insert_len("r1", "r2", None, **rates)).where(F.col("pos") < F.length("r1"))
    after = lambda c: F.expr(f"substring({c}, pos + 1)")
    return rows.select(after("r1").alias("tail1"), after("r2").alias("tail2"))


def consensus(r1: str = "r1", q1: str = "q1", r2: str = "r2", q2: str = "q2") -> Column:
    """struct<seq, qual> of read 1 with base and quality of the mate where the mate's quality is higher.

    Mates of different lengths are aligned at their ends; if a quality string is too short, read 1
    stays as it is.
    """
    a, qa, b, qb = (F.col(c) for c in (r1, q1, r2, q2))
    m = F.least(F.length(a), F.length(b))
    off = F.length(a) - m
    tail = lambda c: F.substring(c, off + 1, m)
    ra, rq = S.complement(F.reverse(F.expr(f"substring({r2}, 1 + length({r2}) - least(length({r1}), length({r2})))"))), F.reverse(F.expr(f"substring({q2}, 1 + length({q2}) - least(length({r1}), length({r2})))"))
    base = F.zip_with(F.split(tail(a), ""), F.split(tail(qa), ""), lambda x, y: F.struct(x.alias("b"), y.alias("q")))
    mate = F.zip_with(F.split(ra, ""), F.split(rq, ""), lambda x, y: F.struct(x.alias("b"), y.alias("q")))
    both = F.zip_with(base, mate, lambda x, y: F.when(F.ascii(y["q"]) > F.ascii(x["q"]), y).otherwise(x))
    head = lambda c: F.substring(c, F.lit(1), off)
    seq = F.concat(head(a), F.concat_ws("", F.transform(both, lambda x: x["b"])))
    qual = F.concat(head(qa), F.concat_ws("", F.transform(both, lambda x: x["q"])))
    short = (F.length(qa) < F.length(a)) | (F.length(qb) < F.length(b))
    return F.when(short | (m <= 0), F.struct(a.alias("seq"), qa.alias("qual"))).otherwise(F.struct(seq.alias("seq"), qual.alias("qual")))

"""Adapter search with few differences, over Arrow batches: all reads of a batch move together.

A semi-global alignment of each adapter to each read. A mismatch costs by the base's quality (0.477
to 4.477; 2.477 without qualities), a gap 4.477 (2.477 for amplicon primers). Against the adapter's full length the cost must stay
below ``epsilon * 2.477 * length + 0.001`` with at most ``ceil(delta * length)`` gaps; an adapter that
runs off the read's end needs ``min_overlap`` bases and the same rate on these. The score is
``(2.477 * bases - cost) / (bases + 1)``; of adapters with the same score the first wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MU = 2.477
GAP = 4.477
MAX_ADAPTERS, MAX_ADAPTER_LENGTH = 96, 64
TYPE = "struct<pos:int,idx:int,score:double>"

# Bases that each IUPAC code stands for.
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT",
    "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}

_PENALTY = np.array([0.477 if q <= 0 else 4.477 if q > 39 else 0.477 + q / 10 for q in range(-33, 223)])
MAX_SEQ = (1 << 14) - 1
_COMP = np.arange(256, dtype=np.uint8)
for _a, _b in ("AT", "CG", "GC", "TA"):
    _COMP[ord(_a)] = ord(_b)


def default_overlap(epsilon: float) -> int:
    return max(int(4 - 10 * epsilon), 1)


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    return out


#: Costs are whole millionths in a number's high bits; below them the way it was reached, and the start.
_UNIT, _WAY, _HIGH = 1_000_000, 14, 16
_BIG = 1 << 60


def _packed(cost: float) -> int:
    return round(cost * _UNIT) << _HIGH


def align(reads: np.ndarray, cost: np.ndarray, size: np.ndarray, adapter: str, epsilon: float, delta: float, min_overlap: int, head: bool, tail: bool = True, gap: float = GAP, every: bool = False) -> tuple[np.ndarray, ...]:
    """Start of the best alignment of ``adapter`` in each read, and its score (-inf: none).

    With ``every`` (row, start, score) of all alignments at the error rate, one for each end in the read and each
    length that runs off it, the score being ``2.477 * bases - cost``.

    ``cost`` has the mismatch costs in whole millionths. A cell holds cost and start in one number, so the better
    way into it is a minimum: of equal costs a match goes before a skipped base of the adapter, that before one
    of the read.
    """
    n, width = reads.shape
    length = len(adapter)
    gaps = math.ceil(delta * length)
    least = min(min_overlap, length - gaps + 1)
    rate = epsilon * MU
    best, at = np.full(n, -np.inf), np.zeros(n, np.int64)
    skip, over = _packed(gap) | 1 << _WAY, _packed(gap) | 2 << _WAY
    clear, low_bits = ~np.int64(3 << _WAY), (1 << _WAY) - 1
    c, nc = (np.full((gaps + 1, n, width + 1), _BIG, np.int64) for _ in range(2))
    c[0] = np.arange(width + 1)
    work, rows, partial, steps = np.empty((n, width), np.int64), np.arange(n), [], {}
    high = cost.astype(np.int64) << _HIGH
    for j in range(1, length + 1):
        letter = adapter[j - 1]
        if letter not in steps:
            same = np.zeros(256, bool)
            same[list(IUPAC_BASES.get(letter, letter).encode())] = True
            steps[letter] = np.where(same[reads], 0, high)
        step = steps[letter]
        for g in range(gaps + 1):
            x = nc[g]
            np.add(c[g][:, :-1], step, out=x[:, 1:])
            x[:, 0] = _packed(rate * j) if g == 0 and head and j <= length - least else _BIG
            if g:
                np.minimum(x[:, 1:], np.add(c[g - 1][:, 1:], skip, out=work), out=x[:, 1:])
                np.minimum(x[:, 0], c[g - 1][:, 0] + skip, out=x[:, 0])
                np.minimum(x[:, 1:], np.add(nc[g - 1][:, :-1], over, out=work), out=x[:, 1:])
                np.bitwise_and(x, clear, out=x)
        c, nc = nc, c
        if tail and least <= j < length:
            ends = c[:, rows, size]
            g = (ends >> _HIGH).argmin(0)
            ends = ends[g, rows]
            partial.append((j, (ends >> _HIGH) / _UNIT, ends & low_bits))
    full = np.minimum.reduce(c >> _HIGH)
    full[np.arange(width + 1)[None, :] > size[:, None]] = _BIG
    if every:
        row, end = np.nonzero(full < (rate * length + 0.001) * _UNIT)
        first = c[:, row, end]
        found = [(row, first[(first >> _HIGH).argmin(0), np.arange(len(row))] & low_bits, length * MU - full[row, end] / _UNIT)]
        for j, low, start in partial:
            row = np.flatnonzero((low < rate * j + 0.001) & (size > 0))
            found.append((row, start[row], j * MU - low[row]))
        return tuple(np.concatenate(x) for x in zip(*found))
    low = full.min(1)
    # of equally good places the last one
    end = width - np.argmax((full == low[:, None])[:, ::-1], 1)
    low = low / _UNIT
    ok = (low < rate * length + 0.001) & (size > 0)
    last = c[:, rows, end]
    start = last[(last >> _HIGH).argmin(0), rows] & low_bits
    best[ok], at[ok] = (length * MU - low[ok]) / (length + 1), start[ok]
    for j, low, start in reversed(partial):
        score = (j * MU - low) / (j + 1)
        more = (low < rate * j + 0.001) & (size > 0) & (score > best + 1e-12)
        best[more], at[more] = score[more], start[more]
    return at, best


def _costs(seqs: list[str], quals: list[str] | None, width: int, base: int = 33) -> np.ndarray:
    """Mismatch costs of reads in whole millionths, by quality where there is one."""
    if quals is None:
        return np.full((len(seqs), width), round(MU * _UNIT))
    marks = _codes([t[: len(x)] for t, x in zip(quals, seqs)], width)
    return np.where(marks > 0, np.rint(_PENALTY * _UNIT).astype(np.int64)[np.clip(marks.astype(int) - base + 33, 0, 255)], round(MU * _UNIT))


def hits(seqs: list[str], quals: list[str] | None, adapters: list[str], epsilon: float = 0.1, delta: float = 0.03, min_overlap: int | None = None, base: int = 33, gap: float = GAP):
    """(read, adapter, start, score) arrays of every alignment at the error rate, sorted; one for each place, the best."""
    least = default_overlap(epsilon) if min_overlap is None else min_overlap
    size = np.array([len(x) for x in seqs], np.int64)
    width = int(size.max(initial=0))
    if width > MAX_SEQ:
        raise ValueError(f"reads of at most {MAX_SEQ} bases")
    out = []
    for a in range(0, len(seqs), 256):
        part = slice(a, min(len(seqs), a + 256))
        reads, cost = _codes(seqs[part], width), _costs(seqs[part], None if quals is None else quals[part], width, base)
        for k, text in enumerate(adapters):
            row, start, score = align(reads, cost, size[part], text, epsilon, delta, least, False, gap=gap, every=True)
            out.append((row + a, np.full(len(row), k), np.minimum(start, size[part][row]), score))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row, idx, start, score = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((-score, idx, start, row))
    row, idx, start, score = (x[order] for x in (row, idx, start, score))
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (idx[1:] != idx[:-1]) | (start[1:] != start[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], idx[new], start[new], score[new]


def scan(seqs: list[str], quals: list[str] | None, adapters: list[str], mode: str = "tail", epsilon: float = 0.1, delta: float = 0.03, min_overlap: int | None = None, base: int = 33, gap: float = GAP):
    """(pos, idx, score) arrays: bases left, adapter number (-1: none found) and score.

    Modes: ``tail`` cuts the adapter and what follows; ``head`` the adapter and what comes before, so
    ``pos`` bases are left at the end; ``any`` is ``tail`` that also takes adapters running off the
    read's head.
    """
    least = default_overlap(epsilon) if min_overlap is None else min_overlap
    n, flip = len(seqs), mode == "head"
    size = np.array([len(x) for x in seqs], np.int64)
    width = int(size.max(initial=0))
    if width > MAX_SEQ:
        raise ValueError(f"reads of at most {MAX_SEQ} bases")
    pos, idx, score = size.copy(), np.full(n, -1), np.full(n, -np.inf)
    for a in range(0, n, 256):
        part = slice(a, min(n, a + 256))
        m = size[part]
        texts = [x[::-1] if flip else x for x in seqs[part]]
        reads = _codes(texts, width)
        cost = _costs(texts, None if quals is None else [(t or "")[::-1] if flip else (t or "") for t in quals[part]], width, base)
        for k, text in enumerate(adapters):
            word = text[::-1] if flip else text
            # an exact whole adapter has the best score there is, so such reads need no alignment
            at = np.array([t.rfind(word) for t in texts], np.int64) if word and not word.strip("ACGT") else np.full(len(texts), -1, np.int64)
            got = np.full(len(texts), len(word) * MU / (len(word) + 1))
            rest = np.flatnonzero(at < 0)
            if len(rest):
                at[rest], got[rest] = align(reads[rest], cost[rest], m[rest], word, epsilon, delta, least, mode == "any", gap=gap)
            more = got > score[part]
            pos[part] = np.where(more, np.clip(at, 0, m), pos[part])
            idx[part] = np.where(more, k, idx[part])
            score[part] = np.where(more, got, score[part])
    return pos, idx, score


def adapter_pos(seq: str, qual: str | None, adapters: list[str], **options) -> Column:
    """struct<pos, idx, score> of the best adapter in each read."""
    if len(adapters) > MAX_ADAPTERS or any(len(a) > MAX_ADAPTER_LENGTH for a in adapters):
        raise ValueError(f"at most {MAX_ADAPTERS} adapters of {MAX_ADAPTER_LENGTH} bases")

    def frame(found) -> pd.DataFrame:
        pos, idx, score = found
        return pd.DataFrame({"pos": pos.astype("int32"), "idx": idx.astype("int32"), "score": np.where(np.isinf(score), np.nan, score)})

    if qual is None:

        @F.pandas_udf(TYPE)
        def run(seqs: pd.Series) -> pd.DataFrame:
            return frame(scan(seqs.fillna("").tolist(), None, adapters, **options))

        return run(F.col(seq))

    @F.pandas_udf(TYPE)
    def run_q(seqs: pd.Series, quals: pd.Series) -> pd.DataFrame:
        return frame(scan(seqs.fillna("").tolist(), quals.fillna("").tolist(), adapters, **options))

    return run_q(F.col(seq), F.col(qual))


def trim_mates(pairs: DataFrame, adapters1: list[str], adapters2: list[str], **options) -> DataFrame:
    """Both mates searched on their own: ``a1`` and ``a2`` (pos, idx, score)."""
    return pairs.withColumns({"a1": adapter_pos("r1", "q1", adapters1, **options), "a2": adapter_pos("r2", "q2", adapters2, **options)})


def rc_score(r1: str, q1: str, r2: str, q2: str, size: int, base: int = 33) -> float:
    """Quality-weighted score of r1[:size] against the reverse complement of r2[:size], per base."""
    if not size:
        return 0.0
    comp = str.maketrans("ACGTacgt", "TGCATGCA")
    mate = r2[:size][::-1].translate(comp)
    code = lambda t: np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    wrong = np.flatnonzero(code(r1[:size]) != code(mate))
    worse = np.minimum(code(q1[:size])[wrong], code(q2[:size][::-1])[wrong]).astype(int)
    return (size * MU - float(_PENALTY[worse - base + 33].sum())) / (size + 1)


def _agreement(r1: np.ndarray, q1: np.ndarray, r2: np.ndarray, q2: np.ndarray, at: int, epsilon: float, base: int = 33) -> float | None:
    """``2.477 * bases - cost`` of r1[:at] against the reverse complement of r2[:at]; null beyond the error rate.

    Of mates of different lengths the bases that both have are compared. An empty insert always agrees.
    """
    if at <= 0:
        return MU * min(len(q1), len(q2)) / 2
    m = min(at, len(r1), len(r2))
    first, second = slice(at - m if len(r2) < at else 0, min(at, len(r1))), slice(at - m if len(r1) < at else 0, min(at, len(r2)))
    a, b = r1[first], _COMP[r2[second][::-1]]
    wrong = np.flatnonzero(a != b)
    cost = float(_PENALTY[np.minimum(q1[first][wrong], q2[second][::-1][wrong]).astype(int) - base + 33].sum())
    return m * MU - cost if cost <= epsilon * MU * m else None


def pair_scan(r1, q1, r2, q2, adapters1, adapters2, allowed: set | None = None, epsilon: float = 0.1, **options) -> list[tuple[int, int, int]]:
    """(pos, idx1, idx2) of each pair, joint: of all places where an adapter may begin in either mate, the best.

    A place counts if the mates are reverse complements up to it, at the error rate. Its score is that
    agreement and the best adapter there in each mate that has one; adapters in both must be an allowed
    pair. Of equal scores the first place wins. Without a place the pair stays whole.
    """
    found: dict[int, dict[int, tuple[list, list]]] = {}
    for mate, (reads, quals, texts) in enumerate(((r1, q1, adapters1), (r2, q2, adapters2))):
        for k, i, at, score in zip(*(x.tolist() for x in hits(reads, quals, texts, epsilon, **options))):
            found.setdefault(k, {}).setdefault(at, ([], []))[mate].append((score, i))
    code = lambda t: np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    out = []
    for k in range(len(r1)):
        best, choice = -1.0, (min(len(r1[k]), len(r2[k])), -1, -1)
        texts = [code(t) for t in (r1[k], q1[k], r2[k], q2[k])] if k in found else []
        for at, (one, two) in sorted(found.get(k, {}).items()):
            agreed = _agreement(*texts, at, epsilon)
            if agreed is None:
                continue
            if one and two:
                ways = [(x + y, i, j) for x, i in one for y, j in two if allowed is None or (i, j) in allowed]
            else:
                ways = [(x, i, -1) for x, i in one] + [(y, -1, j) for y, j in two]
            for score, i, j in ways:
                if agreed + score > best:
                    best, choice = agreed + score, (at, i, j)
        out.append(choice)
    return out


def pair_pos(adapters1: list[str], adapters2: list[str], **options) -> Column:
    """struct<pos, idx1, idx2> of pairs in columns r1, q1, r2, q2."""

    @F.pandas_udf("struct<pos:int,idx1:int,idx2:int>")
    def run(r1: pd.Series, q1: pd.Series, r2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        rows = pair_scan(*(x.fillna("").tolist() for x in (r1, q1, r2, q2)), adapters1, adapters2, **options)
        return pd.DataFrame(rows, columns=["pos", "idx1", "idx2"]).astype("int32")

    return run(*map(F.col, ("r1", "q1", "r2", "q2")))


def amplicon(seqs: list[str], quals: list[str], forward: list[str], reverse: list[str], cut: bool = True, **options) -> pd.DataFrame:
    """Primers at both ends in either orientation: (begin, end, fwd, rev, exchanged).

    The forward primer is looked for at the head and the reverse complement of the reverse primer at the
    tail; and the other way round. The orientation with the higher total score wins. ``cut`` puts the
    bounds inside the primers' inner ends.
    """
    comp = str.maketrans("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN")
    rc = lambda p: p[::-1].translate(comp)
    n = np.array([len(x) for x in seqs])
    best = None
    for flip, (heads, ends) in enumerate(((forward, reverse), (reverse, forward))):
        hp, hi, hs = scan(seqs, quals, heads, "head", gap=MU, **options)
        tp, ti, ts = scan(seqs, quals, [rc(p) for p in ends], "tail", gap=MU, **options)
        score = np.where(hi >= 0, hs, 0.0) + np.where(ti >= 0, ts, 0.0)
        begin = np.where(hi >= 0, n - hp, 0) if cut else np.zeros(len(n), int)
        end = np.where(ti >= 0, tp, n) if cut else n
        now = [begin, np.maximum(begin, end), hi if not flip else ti, ti if not flip else hi, np.full(len(n), bool(flip)), score]
        best = now if best is None else [np.where(score > best[5], y, x) for x, y in zip(best, now)]
    return pd.DataFrame({"begin": best[0].astype("int32"), "end": best[1].astype("int32"), "fwd": best[2].astype("int32"), "rev": best[3].astype("int32"), "exchanged": best[4].astype(bool)})


def amplicon_bounds(forward: list[str], reverse: list[str], **options) -> Column:
    @F.pandas_udf("struct<begin:int,end:int,fwd:int,rev:int,exchanged:boolean>")
    def run(seqs: pd.Series, quals: pd.Series) -> pd.DataFrame:
        return amplicon(seqs.fillna("").tolist(), quals.fillna("").tolist(), forward, reverse, **options)

    return run(F.col("seq"), F.col("qual"))


def junction_cut(pairs: DataFrame, junction: str, min_len: int = 18, **options) -> DataFrame:
    """Mate pairs cut at the junction adapter of either mate.

    What follows a junction in one mate comes from the other side; if it is at least ``min_len`` long and
    the other mate is shorter than that, its reverse complement is given to the other mate. Pairs
    with a mate under ``min_len`` are tagged CONTAMINANT (both) or SHORT (one).
    """
    from ..functions import sequence as S

    rows = pairs.withColumns({"a1": adapter_pos("r1", "q1", [junction], **options), "a2": adapter_pos("r2", "q2", [junction], **options)})
    keep = lambda c, a: F.expr(f"substring({c}, 1, {a}.pos)")
    after = lambda c, a: F.expr(f"CASE WHEN {a}.idx >= 0 THEN substring({c}, {a}.pos + {len(junction)} + 1) ELSE '' END")
    rows = rows.withColumns({"t1": S.revcomp(after("r1", "a1")), "t2": S.revcomp(after("r2", "a2")), "u1": F.reverse(after("q1", "a1")), "u2": F.reverse(after("q2", "a2"))})
    rows = rows.withColumns({c: keep(c, a) for c, a in (("r1", "a1"), ("q1", "a1"), ("r2", "a2"), ("q2", "a2"))})
    give = lambda own, own_q, other, other_q: (
        F.when((F.length(own) < min_len) & (F.length(other) >= min_len), F.col(other)).otherwise(F.col(own)),
        F.when((F.length(own) < min_len) & (F.length(other) >= min_len), F.col(other_q)).otherwise(F.col(own_q)),
    )
    (r1, q1), (r2, q2) = give("r1", "q1", "t2", "u2"), give("r2", "q2", "t1", "u1")
    rows = rows.withColumns({"r1": r1, "q1": q1, "r2": r2, "q2": q2})
    short = [(F.length(c) < min_len) for c in ("r1", "r2")]
    tag = F.when(short[0] & short[1], "CONTAMINANT").when(short[0] | short[1], "SHORT").otherwise("NORMAL")
    return rows.withColumn("tag", tag).select(*pairs.columns, "tag")


def pair_matrix(rows: list[tuple[str, str, bool]], names1: list[str], names2: list[str]) -> set[tuple[int, int]]:
    """Allowed adapter pairs as indexes, from (row_name, col_name, valid)."""
    return {(names1.index(r), names2.index(c)) for r, c, ok in rows if ok and r in names1 and c in names2}

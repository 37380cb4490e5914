"""k-mer graphs of fragments: counting, pruning, sources and sinks, and adapter assembly.

Counting, pruning and the ends of the graph are DataFrame aggregations and anti joins. Only the
pruned graph, which has at most (sum of fragment lengths / threshold) edges, reaches the driver,
where paths are enumerated; fragments are a bounded sample there.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

MAX_K = 35
MAX_PATHS = 10_000
#: A graph of more edges than this is refused with an error: its fragments are no bounded sample, or nothing was pruned.
MAX_EDGES = 200_000


def kmer_rows(frags: DataFrame, k: int, seq: str = "tail", frag_id: str = "frag_id") -> DataFrame:
    """(frag_id, pos, kmer) of every k-mer."""
    return frags.select(F.col(frag_id).alias("frag_id"), F.explode(S.kmers(seq, k)).alias("x")).select("frag_id", "x.pos", "x.kmer")


def kmer_counts(frags: DataFrame, k: int, seq: str = "tail") -> DataFrame:
    return kmer_rows(frags, k, seq).groupBy("kmer").agg(F.count("*").alias("cnt"))


def dup_kmers(frags: DataFrame, k: int, seq: str = "tail") -> DataFrame:
    """k-mers that occur twice or more inside one fragment."""
    inside = F.transform(S.kmers(seq, k), lambda x: x["kmer"])
    twice = frags.select(inside.alias("m")).where(F.size("m") > F.size(F.array_distinct("m")))
    counted = twice.select(F.explode(F.array_distinct(F.filter("m", lambda x: F.size(F.filter("m", lambda y: y == x)) > 1))).alias("kmer"))
    return counted.distinct()


def edges(frags: DataFrame, k: int, seq: str = "tail") -> DataFrame:
    """(src, dst, cnt) of consecutive k-mers, combined before the shuffle."""
    at = F.sequence(F.lit(0), F.length(seq) - k - 1)
    pairs = F.transform(at, lambda i: F.struct(F.substring(F.col(seq), i + 1, F.lit(k)).alias("src"), F.substring(F.col(seq), i + 2, F.lit(k)).alias("dst")))
    rows = frags.where(F.length(seq) > k).select(F.explode(pairs).alias("e"))
    return rows.groupBy("e.src", "e.dst").agg(F.count("*").alias("cnt"))


def pruned(edge_rows: DataFrame, least: int) -> DataFrame:
    return edge_rows.where(F.col("cnt") >= least)


def sources(edge_rows: DataFrame) -> DataFrame:
    """Nodes without an edge into them."""
    return edge_rows.select(F.col("src").alias("kmer")).distinct().join(edge_rows.select(F.col("dst").alias("kmer")).distinct(), "kmer", "left_anti")


def sinks(edge_rows: DataFrame) -> DataFrame:
    """Nodes without an edge out of them."""
    return edge_rows.select(F.col("dst").alias("kmer")).distinct().join(edge_rows.select(F.col("src").alias("kmer")).distinct(), "kmer", "left_anti")


class Graph:
    """A collected k-mer graph. Counts may be added to it, as repeated tries do in the parity mode."""

    def __init__(self):
        self.count: dict[tuple, int] = defaultdict(int)

    def add(self, rows) -> None:
        for src, dst, n in rows:
            self.count[src, dst] += n

    def cut(self, least: int) -> dict[tuple, dict[tuple, int]]:
        out: dict = defaultdict(dict)
        for (a, b), n in self.count.items():
            if n >= least:
                out[a][b] = n
        return out


def simple_paths(out: dict, most: int = MAX_PATHS) -> list[list]:
    """Simple source-to-sink paths, best supported sources first; at most ``most``."""
    targets = {b for nbrs in out.values() for b in nbrs}
    starts = sorted((a for a in out if a not in targets), key=lambda a: (-max(out[a].values()), str(a)))
    found = []
    for start in starts:
        stack = [(start, [start], {start})]
        while stack and len(found) < most:
            node, path, seen = stack.pop()
            after = out.get(node)
            if not after:
                found.append(path)
                continue
            for b in sorted(after, key=lambda x: (after[x], str(x))):
                if b not in seen:
                    stack.append((b, [*path, b], seen | {b}))
    return found


def has_cycle(out: dict) -> bool:
    state: dict = {}
    for root in list(out):
        if root in state:
            continue
        stack = [(root, iter(out.get(root, ())))]
        state[root] = 1
        while stack:
            node, it = stack[-1]
            for b in it:
                if state.get(b) == 1:
                    return True
                if b not in state:
                    state[b] = 1
                    stack.append((b, iter(out.get(b, ()))))
                    break
            else:
                state[node] = 2
                stack.pop()
    return False


def to_dot(out: dict) -> str:
    """The graph as DOT text, for inspection."""
    name = lambda v: v[0] if isinstance(v, tuple) else v
    lines = [f'  "{name(a)}" -> "{name(b)}" [label={n}];' for a, nbrs in out.items() for b, n in nbrs.items()]
    return "digraph kmers {\n" + "\n".join(sorted(lines)) + "\n}\n"


def spell(path: list) -> str:
    text = [v[0] if isinstance(v, tuple) else v for v in path]
    return text[0] + "".join(v[-1] for v in text[1:])


def is_low_complexity(seq: str, k: int, share: float = 0.7) -> bool:
    head = seq[:k]
    return any(head.count(b) >= share * k for b in "ACGT")


def assemble(frags: DataFrame, prune_factor: float = 0.03, sensitive: bool = False, k: int = 10, seq: str = "tail", accumulate: bool = False) -> tuple[str, bool]:
    """The best supported sequence that the fragments share, and whether it is of low complexity.

    Fragments shorter than k are dropped; an edge needs ceil(N * prune_factor / (try + 1)) fragments,
    N counted before dropping. Not found, or of low complexity: k grows by 5 while below 35.
    k-mers that repeat inside a fragment stay apart by the k-mer before them. ``("", False)`` if none.
    ``accumulate`` keeps counts of earlier tries, for parity with a reused graph.
    """
    frags = frags.select(F.col(seq).alias("s")).persist()
    try:
        total = frags.count()
        low = False
        while k < MAX_K:
            graph = Graph()
            answer = ""
            rows = None
            for attempt in range(5 if sensitive else 3):
                least = max(1, math.ceil(total * prune_factor / (attempt + 1)))
                if not sensitive and least < 10:
                    break
                if rows is None or accumulate:
                    table = _context_edges(frags, k)
                    floor = max(1, math.ceil(total * prune_factor / 25))
                    rows = [((r.a, r.pa), (r.b, r.pb), r.cnt) for r in table.where(F.col("cnt") >= (1 if accumulate else floor)).limit(MAX_EDGES + 1).collect()]
                    if len(rows) > MAX_EDGES:
                        raise ValueError(f"more than {MAX_EDGES} edges are left; take fewer fragments or a larger prune_factor")
                    graph.add(rows)
                paths = simple_paths(graph.cut(least))
                if paths:
                    answer = spell(paths[0])
                    break
            if answer and not is_low_complexity(answer, k):
                return answer, low
            if answer and k + 5 >= MAX_K:
                return answer, True
            low = low or bool(answer)
            k += 5
        return "", low
    finally:
        frags.unpersist()


def _context_edges(frags: DataFrame, k: int) -> DataFrame:
    """(a, pa, b, pb, cnt): edges whose repeated k-mers carry the k-mer before them."""
    repeats = dup_kmers(frags, k, "s").withColumnRenamed("kmer", "d")
    at = F.sequence(F.lit(0), F.length("s") - k)
    cut = F.transform(at, lambda i: F.substring(F.col("s"), i + 1, F.lit(k)))
    rows = frags.where(F.length("s") > k).select(cut.alias("m"))
    e = rows.select(F.explode(F.expr("transform(sequence(0, size(m) - 2), i -> struct(IF(i > 0, m[greatest(i - 1, 0)], '') AS p, m[i] AS a, m[i + 1] AS b))")).alias("e")).select("e.*")
    counted = e.groupBy("p", "a", "b").agg(F.count("*").alias("n"))
    da, db = repeats.select(F.col("d").alias("a"), F.lit(True).alias("da")), repeats.select(F.col("d").alias("b"), F.lit(True).alias("db"))
    marked = counted.join(da, "a", "left").join(db, "b", "left")
    return marked.groupBy(
        "a", F.when(F.col("da"), F.col("p")).otherwise("").alias("pa"), "b", F.when(F.col("db"), F.col("a")).otherwise("").alias("pb")
    ).agg(F.sum("n").alias("cnt"))


def umi_size(tails: DataFrame, adapter: str, seq: str = "tail") -> int:
    """Most frequent first offset of the adapter's first five bases; the smallest of ties, 0 if none."""
    best = umi_offsets(tails, adapter, seq).orderBy(F.desc("cnt"), "offset").first()
    return int(best["offset"]) if best else 0


def umi_offsets(tails: DataFrame, adapter: str, seq: str = "tail") -> DataFrame:
    at = F.instr(F.col(seq), adapter[:5]) - 1
    return tails.select(at.alias("offset")).where("offset >= 0").groupBy("offset").agg(F.count("*").alias("cnt"))

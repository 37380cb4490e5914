"""Similarity join of word n-gram sets by a MinHash LSH forest with exact verification.

Texts are sets of five-word shingles (a text of one to four words is one shingle). Each of ``TREES`` prefix
tries labels a set with ``MAX_DEPTH`` min-hashes of its own; sets whose labels begin alike lie under one node.

* ``floor_for`` is the shortest prefix to which matches are shortened: the longest with which a pair at the
  threshold meets in a trie with probability ``RECALL``. Sets that share such a prefix are one node's.
* Inside a node the sets are sorted by their labels, so longer shared prefixes are runs. Runs are joined from
  the whole label on, prefixes being shortened level by level until all sets of the node hang together or
  the floor is reached. Two sets are joined if their sketches (a byte of every min-hash of all tries) agree
  in as many places as a pair at the threshold has with near certainty; what is joined already is not
  compared again, so a node of near copies costs little more than its size. No weak match is closed over.
* Nodes of more than ``NODE`` sets are dealt over several tasks, each pair of parts being one's work.
* Connected components of these joins are candidate groups, verified exactly, in blocks: members are dealt into
  blocks of about ``BLOCK``, and each pair of blocks is one task's work, a blocked matrix product over
  shared shingles. It returns for each member the number of its links and one link to each linked
  neighbourhood, never the pairs. No group is capped; the work of a group of n different near copies is
  n * n / 2 comparisons, as counting their links requires, spread over its block pairs.
* Texts with equal shingle sets are one class member from the start; copies are counted, not paired.

Result: one row for each document with its class (connected over verified links), the class size
and the number of other documents within the threshold. Null and empty texts and texts without a
word have no shingles: each is its own class without links. Null ids take part; the class id is the
smallest id of the class (null if it has none). Repeated rows are documents of their own. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read. Set ids are 64-bit hashes of
whole shingle sets; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MAX_BROADCAST_ROWS, col, dropped, ratio, shuffle_parts, sized, stored, unused
from ._graph import components
from ._words import Words, chunks, mix, words_of
from .sharding import _whole_groups

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 8
RECALL = 0.999
BLOCK = 128
#: Sets of a node that one task joins; it holds about 200 bytes for each.
NODE = 4096


def floor_for(threshold: float, trees: int = TREES, most: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The prefix length down to which matches are shortened for the target recall at the threshold."""
    for depth in range(most, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("too few trees for this recall")


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the text of each, distinct inside a text, ascending by (text, hash)."""
    h = w.hashes()
    grams, at = w.grams(h, k)
    doc = w.doc[at]
    n = np.diff(w.first)
    for i in np.flatnonzero((n > 0) & (n < k)):
        a, b = w.first[i], w.first[i + 1]
        one = Words(w.raw, w.low, w.begin[a:b], w.end[a:b], w.doc[a:b], w.first, w.offset)
        grams, doc = np.append(grams, one.grams(h[a:b], b - a)[0]), np.append(doc, i)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], doc[new]


def _set_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each set; sets are slices of ``grams`` that begin at ``first``, none empty."""
    a = np.add.reduceat(mix(grams), first)
    b = np.bitwise_xor.reduceat(grams, first)
    return mix(a * np.uint64(3) + mix(b)).view(np.int64)


def signatures(docs: DataFrame, trees: int, floor: int, k: int = SHINGLE, depth: int = MAX_DEPTH, seed: int = 5) -> DataFrame:
    """(doc_id, text_id, set_id, nodes, sketch), the last three null without words.

    ``nodes`` has each trie's node at depth ``floor``, ``sketch`` a byte of each min-hash, trie by trie: a trie's
    bytes are the label that its sets are sorted by.
    """
    rng = np.random.default_rng(seed)
    odd = (rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    salt = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            grams, doc = shingle_sets(words_of(b.column(2)), k)
            own, first = np.unique(doc, return_index=True)
            nodes, sketch = np.zeros((len(own), trees), np.uint64), np.zeros((len(own), trees * depth), np.uint8)
            if len(own):
                for t in range(trees):
                    node = np.full(len(own), t, np.uint64)
                    for j in range(t * depth, (t + 1) * depth):
                        least = mix(np.minimum.reduceat((grams ^ salt[j]) * odd[j], first))
                        sketch[:, j] = least & np.uint64(255)
                        if j - t * depth < floor:
                            node = mix(node * np.uint64(31) + least)
                    nodes[:, t] = node
                ids = _set_ids(grams, first)
            at = np.full(b.num_rows, -1)
            at[own] = np.arange(len(own))
            take = pa.array(at, mask=at < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, trees, dtype=np.int32)), pa.array(nodes.view(np.int64).ravel()))
            marks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(trees * depth), len(own), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            sets = pa.array(ids if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets.take(take), lists.take(take), marks.take(take)], ["doc_id", "text_id", "set_id", "nodes", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_id long, set_id long, nodes array<long>, sketch binary")


def least_agreement(threshold: float, hashes: int) -> int:
    """Equal min-hashes that a pair at the threshold has but for 5 standard deviations."""
    return max(1, int(threshold * hashes - 5 * (threshold * (1 - threshold) * hashes) ** 0.5))


def join_node(sketch: np.ndarray, label: np.ndarray, least: int, floor: int) -> list[tuple[int, int]]:
    """Pairs of members that join all those of a node whose sketches hang together; prefixes get shorter level by level."""
    order = np.lexsort(label.T[::-1])
    sketch, label = sketch[order], label[order]
    part, out = np.arange(len(order)), []
    for depth in range(label.shape[1], floor - 1, -1):
        cut = np.flatnonzero((label[1:, :depth] != label[:-1, :depth]).any(1)) + 1 if depth > floor else np.zeros(0, np.int64)
        for run in np.split(np.arange(len(order)), cut):
            rest, front = run[part[run] != part[run[0]]], run[part[run] == part[run[0]]]
            while len(rest):
                if not len(front):  # nothing of the rest is like the parts before
                    first = part[rest[0]]
                    front, rest = rest[part[rest] == first], rest[part[rest] != first]
                    continue
                now, front = front[:32], front[32:]
                near = (sketch[now][:, None] == sketch[rest][None]).sum(-1, dtype=np.int16) >= least
                hit = near.any(0)
                if hit.any():
                    parts, first = np.unique(part[rest[hit]], return_index=True)
                    for p, r in zip(parts, np.flatnonzero(hit)[first]):
                        out.append((int(order[now[near[:, r].argmax()]]), int(order[rest[r]])))
                        part[part == p] = part[now[0]]
                    moved = np.isin(part[rest], part[now[0]])
                    front, rest = np.concatenate([front, rest[moved]]), rest[~moved]
        if (part == part[0]).all():
            break
    return out


def joined(rows: DataFrame, trees: int, depth: int, least: int, floor: int) -> DataFrame:
    """(a, b) joins of sets from rows (cell, tree, set_id, sketch) sorted by cell."""
    size = trees * depth

    def pairs(cell, tree, ids, sketch):
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        n = np.diff(np.append(cut, len(cell)))
        two = cut[n == 2]  # most nodes have two members
        two = two[(sketch[two] == sketch[two + 1]).sum(1) >= least]
        a, b = [ids[two]], [ids[two + 1]]
        for at, k in zip(cut[n > 2].tolist(), n[n > 2].tolist()):
            t = int(tree[at])
            part = slice(at, at + k)
            found = join_node(sketch[part], sketch[part, t * depth : (t + 1) * depth], least, floor)
            if found:
                x, y = np.array(found).T
                a.append(ids[part][x])
                b.append(ids[part][y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, size)]
            held = now if held is None else [np.concatenate(c) for c in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
            if cut:
                yield pairs(*(c[:cut] for c in held))
                held = [c[cut:] for c in held]
        if held is not None:
            yield pairs(*held)

    return rows.select("cell", "tree", "set_id", "sketch").mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, trees: int, depth: int, threshold: float, floor: int, parts: int, most: int = NODE) -> DataFrame:
    """(a, b): joins of sets (set_id, nodes, sketch) that share a node and have like sketches."""
    nodes = stored(sets.select("set_id", F.posexplode("nodes").alias("tree", "node")), "nodes")
    # table of shared nodes first, so that AQE can split the join at a large node
    shared = stored(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = nodes.join(shared, "node").select("set_id", "tree", "node", F.ceil(F.col("n") / most).alias("blocks")).join(sets.select("set_id", "sketch"), "set_id")
    own = F.expr("pmod(xxhash64(set_id, 7), blocks)")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.expr("IF(blocks = 1, array(0L), sequence(0L, blocks - 1))")))
    cells = rows.where("blocks = 1 OR own <> with").select(F.xxhash64("node", F.least("own", "with"), F.greatest("own", "with")).alias("cell"), "tree", "set_id", "sketch")
    cells = cells.repartition(parts, "cell").sortWithinPartitions("cell", "set_id")
    out = stored(joined(cells, trees, depth, least_agreement(threshold, trees * depth), floor).distinct(), "joins")
    dropped(nodes, shared)
    return out


def _linked(sets: list[np.ndarray], num: int, den: int, cross: int | None) -> np.ndarray:
    """Boolean matrix of pairs with similarity of at least num / den, in blocks of shared shingles."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    count = np.diff(np.append(cut, len(flat)))
    many = np.repeat(count > 1, count)  # a shingle of one text is shared with none
    owner, column = owner[many], np.repeat(np.cumsum(count > 1) - 1, count)[many]
    half = n if cross is None else cross
    rest = slice(0, n) if cross is None else slice(cross, n)
    both = np.zeros((half, n if cross is None else n - cross))
    width = 4096
    starts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        if b > a:
            dense = np.zeros((n, width), np.float32)
            dense[owner[a:b], column[a:b] - k * width] = 1
            both += dense[:half] @ dense[rest].T
    near = both * den >= num * (size[:half, None] + size[None, rest] - both)
    if cross is None:
        np.fill_diagonal(near, False)
        return near
    link = np.zeros((n, n), bool)
    link[:cross, cross:], link[cross:, :cross] = near, near.T
    return link


def _roots(link: np.ndarray) -> np.ndarray:
    """Smallest member of each one's connected part."""
    root = np.arange(len(link))
    while True:
        low = np.where(link, root[None, :], len(link)).min(1, initial=len(link))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(set_id, links, other) from rows (cell, side, set_id, weight, grams) sorted by (cell, side).

    A cell is a pair of blocks; sides 0 and 1 of different blocks are compared with each other only,
    side 2 (the block with itself) all with all.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _whole_groups(batches, "cell"):
            side = rows.column("side").to_numpy()
            ids = rows.column("set_id").to_numpy()
            weight = rows.column("weight").to_numpy()
            cross = int((side == 0).sum()) if side[0] != 2 else None
            if len(ids) < 2 or cross in (0, len(ids)):
                continue
            link = _linked([np.frombuffer(g.as_buffer(), np.uint64) for g in rows.column("grams")], num, den, cross)
            links, root = link @ weight, _roots(link)
            out += [(int(ids[i]), int(links[i]), int(ids[root[i]])) for i in np.flatnonzero(link.any(1))]
            if len(out) >= 10_000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return groups.select("cell", "side", "set_id", "weight", "grams").mapInArrow(check, "set_id long, links long, other long")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["set_id", "links", "other"])


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_id, class_key, class_id, class_size, n_links) of every row.

    ``text_id`` is xxhash64 of the text; ``class_key`` tells classes apart, null without words.
    """
    num, den = ratio(threshold)
    parts, floor = shuffle_parts(docs), floor_for(threshold, trees, recall=recall)
    signed = stored(signatures(docs, trees, floor, k), "signatures")
    worded = signed.where("set_id IS NOT NULL")
    members = worded.groupBy("set_id").agg(F.count("*").alias("weight"), F.min("text_id").alias("text_id"), F.min("doc_id").alias("low_id"))
    sets = worded.dropDuplicates(["set_id"]).select("set_id", "nodes", "sketch")
    grouped = components(candidates(sets, trees, MAX_DEPTH, threshold, floor, parts), "candidates")
    # per-class tables are written first, so that AQE can split the joins at a large class
    sizes = stored(grouped.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    wanted = grouped.join(sizes, "component").join(members.select("set_id", "weight", "text_id"), F.col("node") == F.col("set_id"))
    wanted, small = sized(wanted.select("text_id", "set_id", "weight", "component", F.ceil(F.col("n") / block).alias("blocks")), "wanted", MAX_BROADCAST_ROWS // 4)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            grams, doc = shingle_sets(words_of(b.column(b.schema.get_field_index("text"))), k)
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            data = [grams[x:y].tobytes() for x, y in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(data, pa.binary())], ["set_id", "weight", "component", "blocks", "grams"])

    # only texts of candidates are shuffled while their list is small enough to be broadcast
    texts = docs.select(F.xxhash64("text").alias("text_id"), "text")
    texts = texts.join(F.broadcast(wanted.select("text_id")), "text_id", "left_semi") if small else texts
    filled = texts.dropDuplicates(["text_id"]).join(wanted, "text_id").select("set_id", "weight", "component", "blocks", "text")
    filled = filled.mapInArrow(shingles, "set_id long, weight long, component long, blocks long, grams binary")
    own = F.expr("pmod(xxhash64(set_id, 11), blocks)")
    cells = filled.withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    cells = cells.select(
        F.xxhash64("component", F.least("own", "with"), F.greatest("own", "with")).alias("cell"),
        F.expr("CASE WHEN own = with THEN 2 WHEN own < with THEN 0 ELSE 1 END").alias("side"), "set_id", "weight", "grams",
    )
    cells = cells.repartition(parts, "cell").sortWithinPartitions("cell", "side", "set_id")
    found = stored(verify(cells, num, den), "links")
    classes = components(found.select(F.col("set_id").alias("a"), F.col("other").alias("b")), "classes")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    info = members.join(classes, F.col("set_id") == F.col("node"), "left").join(links, "set_id", "left")
    info = info.select("set_id", "weight", "low_id", F.coalesce("component", "set_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    info = stored(info, "info")
    total = stored(info.groupBy("component").agg(F.min("low_id").alias("class_id"), F.sum("weight").alias("class_size")), "totals")
    info = info.join(total, "component").select("set_id", F.col("component").alias("class_key"), "class_id", "class_size", "n_links")
    full = worded.select("doc_id", "text_id", "set_id").join(info, "set_id").drop("set_id")
    bare = signed.where("set_id IS NULL").select("doc_id", "text_id", F.lit(None).cast("long").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return full.select(bare.columns).unionByName(bare)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the lowest id, then the lowest text hash.

    Rows equal in id and text are copies of each other; one of them stays. Rows without words stay.
    """
    found = near_classes(docs, **options).where("class_size > 1")
    key = F.xxhash64("doc_id", "text_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_id"))
    classed = stored(found.select("doc_id", "text_id", "class_key"), "classed")
    names = docs.columns
    row, same, stay = unused(names, "row", "same", "stay")
    kept = classed.groupBy("class_key").agg(first.alias("f")).select(F.xxhash64("f.doc_id", "f.text_id").alias(row), F.lit(True).alias(stay))
    rows = classed.groupBy(key.alias(row)).agg(F.count("*").alias(same)).join(kept, row, "left")
    rows, _ = sized(rows.select(row, (F.col(same) > 1).alias(same), F.coalesce(F.col(stay), F.lit(False)).alias(stay)), "rows")
    dropped(classed)
    joined = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(rows, row, "left")
    alone = joined.where(F.col(stay).isNull() | (F.col(stay) & ~F.col(same))).select(*map(col, names))
    if not rows.where(F.col(same) & F.col(stay)).limit(1).count():
        return alone
    return alone.unionByName(joined.where(F.col(stay) & F.col(same)).dropDuplicates([row]).select(*map(col, names)))

"""URL filter: a trie over reversed host labels, then path segments, with longest match.

A rule is (action, host, path). It fits a url when the url's host is the rule's host or one of its
subdomains and the url's path starts with the rule's path. Of all fitting rules the one with the
most host labels wins, then the one with the longest path; of equal rules ``allow`` wins. A url
that no rule fits gets the method's default verdict, ``allow``.

Null urls and urls without ``://`` have an empty host and path; no rule fits them. Repeated rows
each get their own verdict; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import extended

ACTIONS = ("block", "allow")
DEFAULT = "allow"
#: Above so many rules they are joined by key instead of broadcast as a trie.
MAX_TRIE_RULES = 200_000

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; only A-Z are lower-cased in the host."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


class Trie:
    """Host labels from the right, then whole path segments; a rule's last, open segment is a prefix."""

    def __init__(self, rules):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # from here on: path
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(tail, ("block",))[0] != "allow":
                ends[tail] = (action, host + path)

    def find(self, host: str, path: str):
        """(action, rule) of the longest rule that fits, or None."""
        node, paths = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                paths.append(node[None])
        for node in reversed(paths):  # most host labels first
            best, rest, step = None, path.split("/"), node
            for i in range(len(rest)):
                open_ends = step.get(None)
                if open_ends:
                    left = "/".join(rest[i:])
                    for k in range(len(left), -1, -1) if len(left) < len(open_ends) else sorted(map(len, open_ends), reverse=True):
                        hit = open_ends.get(left[:k])
                        if hit and k <= len(left):
                            best = hit
                            break
                step = step.get(rest[i])
                if step is None or i == len(rest) - 1:
                    break
            if best:
                return best
        return None


def filter_urls(pages: DataFrame, rules, url: str = "url", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules``: a list, or a DataFrame of (action, host, path). The trie is broadcast only up to
    ``max_trie_rules`` rules; beyond that rules are joined on (host suffix, path folder).
    """
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        few = rules.select("action", "host", "path").limit(max_trie_rules + 1).collect()
        if len(few) > max_trie_rules:
            return _filter_by_join(pages, rules, url)
        rules = [tuple(r) for r in few]
    elif len(rules) > max_trie_rules:
        return _filter_by_join(pages, spark.createDataFrame(rules, "action string, host string, path string"), url)
    trie = spark.sparkContext.broadcast(Trie(rules))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], *([] if url in kept else [F.col(f"`{url}`")]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            host, path, rule, verdict = [], [], [], []
            for u in batch.column(batch.schema.get_field_index(url)).to_pylist():
                h, p = split_url(u)
                hit = find(h, p) if h else None
                host.append(h)
                path.append(p)
                rule.append(hit[1] if hit else None)
                verdict.append(hit[0] if hit else DEFAULT)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            new = [pa.array(x, pa.string()) for x in (host, path, rule, verdict)]
            yield pa.RecordBatch.from_arrays(columns + new, [*kept, "host", "path", "rule", "verdict"])

    schema = extended(pages.select(*[F.col(f"`{c}`") for c in kept]), host="string", path="string", rule="string", verdict="string")
    return source.mapInArrow(judge, schema)


def host_of(url):
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) END")
    lower = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _filter_by_join(pages: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """Same result for rule lists of any size: an equi-join on (host suffix, path folder)."""
    host, path = host_of(f"`{url}`")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(kept)], host.alias("host"), path.alias("path"))
    folder = lambda c: F.regexp_extract(c, "^(.*/)?", 0)
    rules = rules.groupBy("host", "path").agg(F.min("action").alias("action")).withColumn("folder", folder("path"))
    rules = rules.select("action", F.col("host").alias("r_host"), F.col("path").alias("r_path"), "folder")
    urls = base.select("host", "path").where("host <> ''").distinct()
    tails = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', i * -1))")
    heads = F.expr("transform(filter(sequence(0, length(path)), i -> i = 0 OR substring(path, i, 1) = '/'), i -> substring(path, 1, i))")
    keyed = urls.withColumn("r_host", F.explode(tails)).withColumn("folder", F.explode(heads))
    hits = keyed.join(rules, ["r_host", "folder"]).where("startswith(path, r_path)")
    rank = F.struct(F.size(F.split("r_host", "[.]")).alias("a"), F.length("r_path").alias("b"), F.concat("r_host", "r_path").alias("rule"), "action")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("m")).select("host", "path", "m.rule", "m.action")
    out = base.join(best, ["host", "path"], "left")
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", F.coalesce("action", F.lit(DEFAULT)).alias("verdict"))

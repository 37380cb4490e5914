"""Quality rules, line first: bad lines are taken out, then documents that lose too much go.

All of it is built-in column expressions in one narrow pass: no shuffle, no Python.

Words are runs of anything but space and the characters 9-13. Base statistics per text:
``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``; a text fails
the base when it has under 50 words, or over half of its words lie in repeated 3-word windows.
Line rules (a line without a word is neutral and is kept):

* punctuation: over 10 % of the line's characters are the symbols ``#*$%&|<>``, or it has no
  letter at all;
* navigation: three or more bars, or at most two words and no closing punctuation;
* boilerplate: the line, lower-cased, holds one of ``PHRASES``, or equals an earlier line.

A document is kept when its base passes and the lines taken out hold at most ``MAX_LOST`` of its
characters. Copies of an earlier line of the same text count as taken out. Null and empty texts have no words and are rejected, ``cleaned`` being empty. Ties do
not arise; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pinned

MAX_LOST = (1, 2)
PHRASES = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "click here", "read more", "sign up", "log in", "subscribe to", "share this", "lorem ipsum", "enable javascript", "skip to content",
)

_WORDS = r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
_LINES = r"split(coalesce(text, ''), '\n')"
_HAS_WORD = r"rlike({0}, '[^\\x20\\x09-\\x0D]')"


def _symbols(c: str) -> str:
    return f"length(regexp_replace({c}, '[^#*$%&|<>]+', ''))"


def line_fails(line: str) -> str:
    """SQL condition: the line breaks a punctuation, navigation or boilerplate rule."""
    phrases = "|".join(PHRASES)
    punctuation = f"10 * {_symbols(line)} > length({line}) OR NOT rlike({line}, '\\\\p{{L}}')"
    bars = f"length({line}) - length(replace({line}, '|', '')) >= 3"
    short = f"NOT rlike({line}, '[.!?\"\\':;)]\\\\s*\\\\z') AND size(split(trim({line}), '\\\\s+')) <= 2"
    return f"({punctuation} OR {bars} OR ({short}) OR rlike(lower({line}), '{phrases}'))"


def repeat_words() -> str:
    """Words covered by 3-word windows that occur twice or more in the same text.

    Texts whose windows are all distinct (a hash-set test) end there. Otherwise windows are sorted
    with their positions, those equal to a neighbour are kept, and the union of their spans is
    measured over ascending positions: n log n, never a scan per window.
    """
    grams = "transform(sequence(0, size(words) - 3), i -> struct(words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i AS p))"
    same = lambda x, y: f"({x}.a = {y}.a AND {x}.b = {y}.b AND {x}.c = {y}.c)"
    hits = (
        f"transform(array({grams}), s -> transform(array(array_sort(s)), t -> array_sort(transform("
        f"filter(t, (x, i) -> (i > 0 AND {same('x', 't[i - 1]')}) OR (i < size(t) - 1 AND {same('x', 't[i + 1]')})), x -> x.p))))[0][0]"
    )
    cover = f"transform(array({hits}), h -> aggregate(h, struct(0 AS n, -3 AS last), (s, p) -> struct(s.n + least(3, p - s.last) AS n, p AS last), s -> s.n))[0]"
    plain = "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    return f"CASE WHEN size(words) < 4 THEN 0 WHEN size(array_distinct({plain})) = size(words) - 2 THEN 0 ELSE {cover} END"


def judge(docs: DataFrame, max_lost: tuple[int, int] = MAX_LOST) -> DataFrame:
    """(doc_id, base statistics, n_bad_lines, lost_chars, base_failed, kept, cleaned)."""
    num, den = max_lost
    base = docs.select("doc_id", "text").withColumns({"words": pinned(F.expr(_WORDS)), "lines": pinned(F.expr(_LINES))})
    has = _HAS_WORD.format("l")
    told = f"transform(lines, (l, i) -> struct(l AS l, NOT {has} AS blank, {has} AND {line_fails('l')} AS bad))"
    rows = base.select(
        "doc_id",
        F.expr("CAST(size(words) AS BIGINT)").alias("n_words"),
        F.expr(r"CAST(length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '')) AS BIGINT)").alias("word_chars"),
        F.expr(f"CAST({_symbols("coalesce(text, '')")} AS BIGINT)").alias("n_symbols"),
        F.expr(f"transform(array(filter(lines, l -> {has})), x -> CAST(size(x) - size(array_distinct(x)) AS BIGINT))[0]").alias("n_dup_lines"),
        F.expr(f"CAST({repeat_words()} AS BIGINT)").alias("n_repeat_words"),
        F.expr(told).alias("told"),
    )
    first = "array_distinct(transform(filter(told, x -> NOT x.bad), x -> x.l))"
    chars = lambda a: f"aggregate({a}, 0L, (s, x) -> s + length(x.l))"
    out = rows.select(
        "*",
        F.expr(f"CAST(size(filter(told, x -> NOT x.blank)) - size(array_distinct(transform(filter(told, x -> NOT x.bad AND NOT x.blank), x -> x.l))) AS BIGINT)").alias("n_bad_lines"),
        F.expr(f"aggregate({first}, 0L, (s, x) -> s + length(x))").alias("left_chars"),
        F.expr(chars("told")).alias("all_chars"),
        F.expr(f"array_join({first}, '\n')").alias("cleaned"),
        F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
    )
    kept = f"NOT base_failed AND {den} * (all_chars - left_chars) <= {num} * all_chars"
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.expr(kept).alias("kept"), "n_bad_lines", F.expr("all_chars - left_chars").alias("lost_chars"), "cleaned",
    )

"""Deterministic reads, pairs and intervals derived from the driver's tables.

The tables hold no reads, so they are made by rules on keys: bases from md5 digests, a read-through
into the adapter and a poly-A fill, substitutions and N at places given by the key. ``SQL`` has the
same rules as text that DuckDB runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default adapter pair.
ADAPTER1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC"
ADAPTER2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTA"
READ_LENGTH = 100

_HEX = "0123456789abcdef"


def _digests(key: str, salts: str) -> str:
    return "concat(" + ", ".join(f"md5(concat({key}, '{s}'))" for s in salts) + ")"


def _bases(key: str) -> str:
    return f"translate({_digests(key, 'abcd')}, '{_HEX}', 'ACGTACGTACGTACGT')"


_QUAL = f"substring(translate({_digests('k', 'qrst')}, '{_HEX}', '!#%,05:;<=>?@AFI'), 1, 100)"

_READS = f"""
SELECT read_id, concat('read_', k) AS name,
       CASE WHEN read_id % 11 = 0 THEN replace(s, 'G', 'N')
            WHEN read_id % 7 = 0 THEN concat(substring(s, 1, CAST(read_id % 90 AS INT)), 'N', substring(s, CAST(read_id % 90 AS INT) + 2, 100))
            ELSE s END AS seq,
       {_QUAL} AS qual, insert_len
FROM (SELECT read_id, k, insert_len,
             substring(concat(substring({_bases('k')}, 1, insert_len), '{ADAPTER1}', repeat('A', 100)), 1, 100) AS s
      FROM (SELECT read_id, CAST(read_id AS STRING) AS k, CAST(15 + read_id % 120 AS INT) AS insert_len
            FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS read_id FROM lineitem) x) y) z
"""

_PAIRS = f"""
SELECT pair_id, insert_len,
       CASE WHEN pair_id % 5 = 0 THEN concat(substring(a, 1, CAST(pair_id % 17 AS INT)), translate(substring(a, CAST(pair_id % 17 AS INT) + 1, 1), 'ACGT', 'TGCA'), substring(a, CAST(pair_id % 17 AS INT) + 2, 100)) ELSE a END AS r1,
       b AS r2, {_QUAL} AS q1, reverse({_QUAL}) AS q2
FROM (SELECT pair_id, k, insert_len,
             substring(concat(f, '{ADAPTER1}', repeat('A', 100)), 1, 100) AS a,
             substring(concat(reverse(translate(f, 'ACGT', 'TGCA')), '{ADAPTER2}', repeat('A', 100)), 1, 100) AS b
      FROM (SELECT pair_id, k, insert_len, substring({_bases('k')}, 1, insert_len) AS f
            FROM (SELECT o_orderkey AS pair_id, CAST(o_orderkey AS STRING) AS k, CAST(40 + o_orderkey % 80 AS INT) AS insert_len FROM orders) x) y) z
"""

_TAILS = f"""
SELECT frag_id, CASE WHEN frag_id % 4 = 1 THEN concat(substring(t, 1, CAST(frag_id % 31 AS INT)), translate(substring(t, CAST(frag_id % 31 AS INT) + 1, 1), 'ACGT', 'CGTA'), substring(t, CAST(frag_id % 31 AS INT) + 2, 100)) ELSE t END AS tail
FROM (SELECT pair_id AS frag_id, substring(r1, insert_len + 1, 100) AS t FROM ({_PAIRS}) p WHERE insert_len < 100) v"""

_CONTIGS = f"SELECT concat('chr', k) AS chrom, {_bases('k')} AS seq FROM (SELECT CAST(p_partkey AS STRING) AS k FROM part) x"

_QUERIES = """
SELECT concat('chr', CAST(o_custkey % 7 AS STRING)) AS chrom, CAST(o_orderkey * 37 % 100000 AS BIGINT) AS begin,
       CAST(o_orderkey * 37 % 100000 + o_orderkey % 90 AS BIGINT) AS stop, o_orderkey AS id
FROM orders"""

_FEATURES = """
SELECT DISTINCT concat('chr', CAST(l_partkey % 7 AS STRING)) AS chrom, CAST(l_orderkey * 53 % 100000 AS BIGINT) AS begin,
       CAST(l_orderkey * 53 % 100000 + 10 + l_linenumber * 9 AS BIGINT) AS stop, l_orderkey * 10 + l_linenumber AS id,
       concat('type', CAST(l_suppkey % 5 AS STRING)) AS gene_type
FROM lineitem WHERE l_linenumber <= 2"""

SQL = {"reads": _READS, "pairs": _PAIRS, "tails": _TAILS, "contigs": _CONTIGS, "queries": _QUERIES, "features": _FEATURES}
_FROM = {"reads": ["lineitem"], "pairs": ["orders"], "tails": ["orders"], "contigs": ["part"], "queries": ["orders"], "features": ["lineitem"]}


_made: dict[tuple[str, str], str] = {}


def materialise(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write all views to ``folder``; queries of this process then read them instead of deriving them anew."""
    for name in SQL:
        path = f"{folder}/{name}"
        view(spark, sf_dir, name).write.mode("overwrite").parquet(path)
        _made[sf_dir, name] = path


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the Parquet tables, without temporary names in the catalog."""
    if (sf_dir, name) in _made:
        return spark.read.parquet(_made[sf_dir, name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _FROM[name]}
    text = SQL[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    made = spark.sql(text, **tables)
    # made once for each row, like columns of a file: filters on them must not copy the digests downwards
    once = {c: F.when(F.monotonically_increasing_id() >= 0, F.col(c)) for c in ("seq", "qual", "r1", "r2", "q1", "q2", "tail") if c in made.columns}
    return made.withColumns(once) if once else made


def oracle(name: str, body: str, *more: str) -> str:
    """DuckDB SQL: ``body`` over the named views."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in (name, *more))
    return f"WITH {views}" + (", " + body[5:] if body.startswith("WITH ") else "\n" + body)



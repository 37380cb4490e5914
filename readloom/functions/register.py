"""SQL functions of the library. Those that SQL can express are SQL functions, inlined by Catalyst."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import adapter, overlap

_SQL = {
    "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTacgt', 'TGCATGCA'))",
    "hamming(a STRING, b STRING) RETURNS INT": "aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN x IS NOT NULL AND y IS NOT NULL AND (x <> y OR x = 'N') THEN 1 ELSE 0 END), 0, (s, x) -> s + x)",
    "kmers(s STRING, k INT) RETURNS TABLE(pos INT, kmer STRING)": "SELECT p AS pos, substring(s, p + 1, k) AS kmer FROM (SELECT explode(CASE WHEN length(s) >= k THEN sequence(0, length(s) - k) ELSE array() END) AS p)",
}


def register(spark: SparkSession) -> None:
    """Make ``revcomp``, ``hamming``, ``kmers`` (table function), ``overlap_insert_len`` and ``adapter_pos`` known to SQL."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("int")
    def overlap_insert_len(r1: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series(overlap.scan(r1.fillna("").tolist(), r2.fillna("").tolist()).astype("int32"))

    @F.pandas_udf(adapter.TYPE)
    def adapter_pos(seq: pd.Series, qual: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(index=seq.index, columns=["pos", "idx", "score"], dtype=float)
        for a in text.unique():
            rows = text == a
            quals = qual[rows].fillna("").tolist()
            pos, idx, score = adapter.scan(seq[rows].fillna("").tolist(), quals, [a])
            out.loc[rows, ["pos", "idx", "score"]] = list(zip(pos, idx, score))
        return out.astype({"pos": "int32", "idx": "int32"})

    spark.udf.register("overlap_insert_len", overlap_insert_len)
    spark.udf.register("adapter_pos", adapter_pos)

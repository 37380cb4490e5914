"""Token counts through a digest cache.

A count is stored under (content digest, tokenizer-version digest). Texts whose digest is in the
cache are never encoded again; of the others each distinct text is encoded once and its count is
appended. Normalised content: a null text is the empty text and nothing else is changed, for any
other normalisation would change counts.

Texts are shuffled only if they are misses, and copies are combined before the shuffle. The last
join carries digests and numbers only; a digest that many rows share is split by AQE's skew join.
Null ids are kept; repeated rows each get their count; two runs that append the same digest agree,
so duplicates in the cache are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .encoders import encoder, text_lists, version


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    rows = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``cache`` grows by the misses."""
    spark, tokenizer = docs.sparkSession, version(vocabulary)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    misses = keyed.select("digest", "text")
    if _exists(spark, cache):
        misses = misses.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for part, texts in text_lists(batches):
            n = [len(x) // enc.width for x in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    fresh = misses.dropDuplicates(["digest"]).select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    numbers = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # written first: a join straight on two shuffles is one that AQE can split at a hot digest
    out = numbers.join(stored(read_cache(spark, cache, tokenizer), "counts"), "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

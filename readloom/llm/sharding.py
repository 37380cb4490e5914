"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into buckets by a seeded hash of id, text and, for rows equal in both,
their number inside the task that reads them; so neither a hot id nor a hot row fills a bucket. There are
as many buckets as keep each one memory-sized, several to a shuffle partition. Each bucket is put into
a canonical order, permuted with a Fisher-Yates shuffle seeded by (seed, bucket) and written. Pass two
reads the buckets back. They follow one another in the whole order, and shards are cut from that order, so
that shard counts differ by at most one (law ``rows``) and slots are gapless. Copies of a text are
rows of their own and are dispersed.

Same seed, rows, splits and bucket count: same result, also when a task is rerun. Null ids and texts are
ordinary values (a null text has no bytes); rows equal in id and text are interchangeable; an empty
table gives no shards; other columns are carried into the shard files, where a column named ``slot`` or
``shard`` of the input gets underscores behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, dropped, extended, shuffle_parts, stored, unused, work_dir

#: A bucket is held in memory. The starts of all buckets are broadcast, 8 bytes each: 25 MB for 100 TB.
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1 (``Generator.permutation`` is Fisher-Yates)."""
    return np.random.default_rng([seed & 0xFFFFFFFF, bucket]).permutation(n)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of each run of equal keys in sorted batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _numbered(docs: DataFrame, key: str, number: str) -> DataFrame:
    """``docs`` with ``number``: how many rows of the same ``key`` came before a row in its task."""
    at = docs.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 0), np.int64)  # keys met, ascending, and how often
        for b in batches:
            keys = b.column(at).to_numpy()
            known, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
            order = np.argsort(inverse, kind="stable")
            inside = np.empty(len(keys), np.int64)
            inside[order] = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            place = np.searchsorted(seen[0], known)
            old = np.zeros(len(known), np.int64)
            if seen.shape[1]:
                met = seen[0][np.minimum(place, seen.shape[1] - 1)] == known
                old[met] = seen[1][place[met]]
                seen[1][place[met]] += n[met]
            else:
                met = np.zeros(len(known), bool)
            seen = np.insert(seen, place[~met], np.stack([known[~met], n[~met]]), 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside + old[inverse])], [*b.schema.names, number])

    return docs.mapInArrow(count, extended(docs, **{number: "long"}))


def write_shards(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> str:
    """Write all rows into ``path``/shard=K as Parquet with a column ``slot``; returns the path."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "shards")
    for name in ("slot", "shard"):
        for old in [c for c in docs.columns if c.lower() == name]:
            docs = docs.withColumnRenamed(old, unused([*docs.columns, "slot", "shard"], old)[0])
    names = docs.columns
    key, number, bucket, place = unused([*names, "slot", "shard"], "key", "number", "bucket", "place")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = shuffle_parts(docs)
    buckets = max(-(-size // bucket_bytes), parts)
    keyed = _numbered(docs.withColumn(key, F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))), key, number)
    dealt = keyed.withColumn(bucket, F.pmod(F.xxhash64(key, number), F.lit(buckets)).cast("int"))
    dealt = dealt.repartition(parts, bucket).sortWithinPartitions(bucket, "doc_id", key)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _whole_groups(batches, bucket):
            rows = rows.select([*names, bucket]).combine_chunks()
            rows = rows.take(fisher_yates(rows.num_rows, seed, b)).append_column(place, pa.array(np.arange(rows.num_rows)))
            yield from rows.combine_chunks().to_batches(max_chunksize=2000)

    rows = stored(dealt.mapInArrow(shuffle, extended(docs, **{bucket: "int", place: "long"})), "scattered")
    counts = np.zeros(buckets + 1, np.int64)
    for b, n in rows.groupBy(col(bucket).alias("b")).count().toLocalIterator():
        counts[b + 1] = n
    start, total = spark.sparkContext.broadcast(np.cumsum(counts)), int(counts.sum())

    def number_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = start.value[b.column(len(names)).to_numpy()] + b.column(len(names) + 1).to_numpy()
            shard = at * n_shards // total  # shard s begins at ceil(s * total / n_shards)
            slot = at - (shard * total + n_shards - 1) // n_shards
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(slot), pa.array(shard.astype(np.int32))], [*names, "slot", "shard"])

    out = rows.mapInArrow(number_all, extended(docs, slot="long", shard="int"))
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    dropped(rows)
    return path


def read_shards(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def shard_digest(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shards and reads them back: (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    schema = extended(docs.select("doc_id", "text"), slot="long", shard="int")
    rows = read_shards(docs.sparkSession, write_shards(docs.select("doc_id", "text"), n_shards, seed, bucket_bytes), schema)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

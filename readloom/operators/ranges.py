"""Generic record-range operations as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.framing import with_ordinal


def irange(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last).withColumnRenamed("id", "value")


def indexed(df: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """An ordinal in the order of the given columns."""
    return with_ordinal(df, *order, start=start)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array column."""
    return df.withColumn(column, F.explode(column))


def at(values: DataFrame, positions: DataFrame, key: str = "ordinal") -> DataFrame:
    """Gather: the rows of ``values`` at the given positions, one for each request."""
    return positions.join(values, key)


def segment(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``df`` with ``segment`` 0..n-1: consecutive parts whose sizes differ by at most one."""
    rows = with_ordinal(df, *order)
    total = rows.count()
    size, more = divmod(total, n)
    edge = more * (size + 1)
    part = F.when(F.col("ordinal") < edge, F.floor(F.col("ordinal") / max(size + 1, 1))).otherwise(more + F.floor((F.col("ordinal") - edge) / max(size, 1)))
    return rows.withColumn("segment", part.cast("int")).drop("ordinal")


def to_map(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the first value of each key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def split(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """Parts of a delimited string with their position."""
    parts = F.split(F.col(column), f"\\Q{delimiter}\\E")
    return df.select("*", F.posexplode(parts).alias("part_no", "part"))

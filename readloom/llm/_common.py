"""Shared plumbing of the training-data operators: work folders and written tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import dropped, source_bytes, stored, work_dir  # noqa: F401 (for the operators)

#: Rows of a key list that is broadcast: 1,000,000 longs are about 30 MB in a hash relation.
MAX_BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, label: str, rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` written, and marked for broadcast if it has at most ``rows`` rows (then true)."""
    df = stored(df, label)
    small = df.count() <= rows
    out = F.broadcast(df) if small else df
    out._work_dir = df._work_dir
    return out, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratio(value: float) -> tuple[int, int]:
    """A decimal threshold as integers (numerator, denominator), for exact comparisons."""
    f = Fraction(str(value))
    return f.numerator, f.denominator


#: Source bytes for each partition of a shuffle whose number is given; such partitions spill, they needn't fit.
PART_BYTES = 512 << 20


def shuffle_parts(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df`` that needs a number: the session's, or more as its files are larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes(df) // PART_BYTES))


def unused(names, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that none of ``names`` is equal to, in any case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pinned(c: Column) -> Column:
    """``c``, computed where it is written: the optimizer doesn't copy it into later filters.

    A filter pushed below the column would hold it once for each use, even inside lambdas.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType()}


def extended(df: DataFrame, **new: str) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, _TYPES[v]) for k, v in new.items())])

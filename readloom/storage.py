"""Written tables in the cluster's shared folder, to cut lineage and to fix a row order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset on one machine (tests), a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="readloom-")
        atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` and read it back. A lost executor costs a task, not the lineage before it.

    Spark removes the job's shuffle files once the table is written.
    """
    spark = df.sparkSession
    path, before = work_dir(spark, label), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_dir = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_work_dir", None)
        if path:
            sc = t.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, from the planner's figures for its leaves; unknown sizes count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(n for n in sizes if n < 1 << 60)

"""A streaming front end: the trimming projections over files as they arrive.

Trimming is stateless for each record, so a stream needs no watermark or state; adapters are detected
once on a batch and then frozen. A file that arrives is one row, framed into records by an Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapter, disposition

_READS = "file string, ordinal long, name string, seq string, qual string"


def stream_fastq(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(file, ordinal, name, seq, qual) of FASTQ files (gzip too) as they appear in ``folder``."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "value")

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = [x.rstrip("\r") for x in text.split("\n")]
                n = len(lines) // 4
                names, seqs, quals = ([x for x in lines[i : 4 * n : 4]] for i in (0, 1, 3))
                columns = [pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([x[1:] for x in names], pa.string()), pa.array([x.upper() for x in seqs], pa.string()), pa.array(quals, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "ordinal", "name", "seq", "qual"])

    return rows.mapInArrow(frame, _READS)


def stream_trim(reads: DataFrame, adapters: list[str], epsilon: float = 0.1, **options) -> DataFrame:
    """The batch trimming plan over a stream of reads."""
    found = reads.withColumn("a__", adapter.adapter_pos("seq", "qual", adapters, epsilon=epsilon))
    return disposition.trimmed(disposition.dispose(found, F.col("a__.pos"), **options).drop("a__"))


def write_stream(trimmed: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append trimmed records as Parquet; exactly once by the stream's checkpoint."""
    w = trimmed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()

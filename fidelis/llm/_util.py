"""Shared by the operators: durable tables, split of rows, text of a batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, and Spark runs on one machine, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fidelis-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


_MADE: list[str] = []


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table (in folders by a column) in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fidelis-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cleared(spark: SparkSession) -> int:
    """Deletes all tables that written() made so far, once results that stand on them are kept; how many there were."""
    for path in _MADE:
        _delete(spark, path)
    made = len(_MADE)
    _MADE.clear()
    return made


def dropped(*tables: DataFrame, only: str = "") -> None:
    """Deletes tables made by written() that nothing will read again, or only a folder of theirs."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/fidelis-" in path and path.endswith(only):
                _delete(spark, path)


def released(spark: SparkSession) -> None:
    """Shuffle files of plans that are done go from the executors' disks now, not when the driver next happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows whose column (text or bytes) holds about size bytes at most; a larger value stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        below = ends[at - 1] if at else 0
        end = min(int(np.searchsorted(ends, below + size, "right")), at + rows, batch.num_rows)
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which later stages use again, gives what it has freed back to the system."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

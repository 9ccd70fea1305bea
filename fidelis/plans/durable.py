"""Tables that several branches of a plan read: written once to the shared folder, safe from lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []


def cleared(spark: SparkSession) -> int:
    """Deletes the folders made here so far, once nothing will read what stands on them; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _MADE:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    made = len(_MADE)
    _MADE.clear()
    return made


def folder(spark: SparkSession) -> str:
    """A new folder under that of spark.checkpoint.dir. Only a session of one machine may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fidelis-"))
        at = spark.sparkContext.getCheckpointDir()
    _MADE.append(f"{at.rstrip('/')}/fidelis-{uuid.uuid4().hex}")
    return _MADE[-1]


def durable(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a shared folder."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables on the way: written once, read by all that follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where the setting is unset in a local session a temporary folder is set for it; on a
    cluster that is an error, as other machines wouldn't see it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldweave-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/fieldweave-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet below ``spark.checkpoint.dir``, read back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    if path := getattr(df, "_written_path", None):
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

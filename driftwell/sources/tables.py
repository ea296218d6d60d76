"""Intermediate tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one of a local session, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark, "_driftwell_dir", None) or tempfile.mkdtemp(prefix="driftwell-")
        spark._driftwell_dir = named
    return named.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, *more: DataFrame) -> DataFrame:
    """df and rows of the same columns, written to the shared folder and read again; the table goes when the driver ends, or before that by dropped()."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    for part in (df, *more):
        part.select(*df.columns).write.mode("append").parquet(path)
    at, files = _files(df.sparkSession, path)
    files.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        at, files = _files(df.sparkSession, df._written)
        files.delete(at, True)

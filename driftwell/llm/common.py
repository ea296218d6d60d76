"""Shared helpers: written tables in the cluster's shared folder, graph components, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


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


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver ends, or before that by drop_stash().
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    at, files = file_system(df.sparkSession, path)
    df.write.parquet(path)
    files.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a table written by stash() that nothing reads any more."""
    path = getattr(df, "_stashed", None)
    if path:
        at, files = file_system(df.sparkSession, path)
        files.delete(at, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star steps, each a min per node and an equi-join, until the star
    forest no longer changes; every round is cut by a written table.  Isolated nodes have no row.
    Joins are told to merge, as written tables are sized by their compressed files.
    """
    now = stash(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.hint("merge"), "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e"))
            .select(F.col("e.x").alias("u"), F.col("e.y").alias("v"))
        )
        after = stash(small.where("u <> v").distinct())
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(now)
        now = after
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)


def number_within(df: DataFrame, by: list[str], order: list[str], out: str, buckets: int = 256, bucket: Column | None = None) -> DataFrame:
    """Gapless long `out` from 0 within each value of `by`, in order of a bucket (that of the `order` columns' hash, unless given), then the columns.

    Rows are numbered inside (by, bucket) and offset by a running total over the few (by, bucket)
    counts, so no task sorts a whole value of `by`.  `by` must have few values.
    """
    df = df.withColumn("_b", (F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket).cast("int"))
    counts = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    keys = [*by, "_b"]
    renamed = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_o")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (
        df.withColumn("_r", F.row_number().over(inside).cast("long") - 1)
        .join(renamed, on)
        .withColumn(out, F.col("_r") + F.col("_o"))
        .drop("_r", "_o", "_b", *[f"_k{i}" for i in range(len(keys))])
    )

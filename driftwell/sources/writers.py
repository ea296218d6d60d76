"""Sinks: result documents as rows of JSON, CSV, and model snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_results(records: DataFrame, bucket: str, span: int, score: str) -> DataFrame:
    """One document a bucket: its largest score, its number of records, its length."""
    b = records.groupBy(F.col(bucket).alias("timestamp")).agg(F.max(score).alias("anomaly_score"), F.count(F.lit(1)).alias("record_count"))
    return b.withColumn("bucket_span", F.lit(span)).withColumn("is_interim", F.lit(False))


def as_documents(df: DataFrame, kind: str) -> DataFrame:
    """(document): each row as {"kind": {...}}."""
    return df.select(F.to_json(F.struct(F.struct(*df.columns).alias(kind))).alias("document"))


def model_plot(scores: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Lower and upper bounds, median and actual value of every bucket."""
    spread = F.coalesce(F.col("spread"), F.lit(0.0))
    return scores.select(*keys, bucket, (F.col("typical") - 1.96 * spread).alias("model_lower"), (F.col("typical") + 1.96 * spread).alias("model_upper"), F.col("typical").alias("model_median"), F.col("actual"))


def annotations(changes: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """One annotation a detected change."""
    return changes.select(*keys, F.col(bucket).alias("timestamp"), F.concat_ws(" ", F.lit("Detected"), F.regexp_replace("kind", "_", " "), F.format_string("of %.4g", "size")).alias("annotation"), F.lit("model_change").alias("event"))


def size_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many models (keys) and rows there are."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("total_models"), F.sum("_n").alias("total_rows"))


def data_summary(df: DataFrame, columns: list[str], categorical: list[str]) -> DataFrame:
    """(document): one that names the columns and says which are categorical, and one a row of df with its values as text; null stays null."""
    head = F.struct(
        F.lit(len(columns)).alias("num_columns"),
        F.array(*map(F.lit, columns)).alias("column_names"),
        F.array(*[F.lit(c in categorical) for c in columns]).alias("column_is_categorical"),
    )
    rows = df.select(F.to_json(F.struct(F.array(*[F.col(c).cast("string") for c in columns]).alias("data"))).alias("document"))
    return df.sparkSession.range(1).select(F.to_json(head).alias("document")).unionByName(rows)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_snapshot(df: DataFrame, path: str) -> None:
    """Model state as Parquet; restore_snapshot() reads it back."""
    df.write.mode("overwrite").parquet(path)


def restore_snapshot(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""Joins where one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT, SALTS = 256, 64


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, spread: list[str], wide: bool = False) -> DataFrame:
    """rows joined with the table, one row a key, whose column `count` says how many rows have the key.

    Keys of at least one in HOT rows, of which there can't be more than HOT, are known to every task; their rows are dealt
    to SALTS groups by the columns `spread`, and their row of the table is repeated for each.  Other keys hold few rows.  Null keys join nothing.
    wide: the table may be far larger than its compressed files, by which Spark sizes it, so it is told to merge.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) * HOT >= total).select(*[F.col(c).alias(f"_hot_{c}") for c in on])
    same = [F.col(c) == F.col(f"_hot_{c}") for c in on]
    salted = (
        rows.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), same, "left")
        .withColumn("_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0))
        .drop("_is_hot", *[f"_hot_{c}" for c in on])
    )
    salts = F.when(F.col(count) * HOT >= total, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = table.withColumn("_salt", F.explode(salts))
    repeated = repeated.hint("merge") if wide else repeated
    return salted.withColumn("_salt", F.col("_salt").cast("long")).join(repeated, [*on, "_salt"]).drop("_salt")

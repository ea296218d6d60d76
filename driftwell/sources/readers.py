"""Sources: CSV, newline-delimited JSON, length-encoded records, and time parsing."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """Quoted CSV with a header; every column text unless a schema is given; quotes may hold newlines."""
    r = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (r.schema(schema) if schema else r).csv(path)


def split_csv_lines(df: DataFrame, line: str, fields: list[str], delimiter: str = ",") -> DataFrame:
    """df with one text column a field of a CSV line."""
    ddl = ", ".join(f"`{f}` string" for f in fields)
    return df.withColumn("_c", F.from_csv(line, ddl, {"sep": delimiter, "escape": '"'})).select("*", *[F.col("_c").getField(f).alias(f) for f in fields]).drop("_c")


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document a line; without a schema, a map of top-level keys to text (documents may differ)."""
    if schema:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", STRINGS).alias("fields")).where("fields is not null")


def decode_length_encoded(data: bytes) -> list[dict[str, str]]:
    """Records of (int32 big-endian field count, then per field int32 length and bytes); the first one names the fields."""
    at, names, out = 0, None, []
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">i", data, at)
        at += 4
        row = []
        for _ in range(n):
            (size,) = struct.unpack_from(">i", data, at)
            at += 4
            if size < 0 or at + size > len(data):
                raise ValueError("a field runs past the end")
            row.append(data[at : at + size].decode("utf-8", "replace"))
            at += size
        if names is None:
            names = row
        elif len(row) != len(names):
            raise ValueError(f"a record has {len(row)} fields, not {len(names)}")
        else:
            out.append(dict(zip(names, row)))
    return out


def encode_length_encoded(names: list[str], rows: list[list[str]]) -> bytes:
    parts = []
    for row in [names, *rows]:
        parts.append(struct.pack(">i", len(row)))
        for v in row:
            b = ("" if v is None else str(v)).encode("utf-8")
            parts.append(struct.pack(">i", len(b)) + b)
    return b"".join(parts)


def read_length_encoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields): the records of length-encoded files; files are the unit of parallelism."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = decode_length_encoded(content)
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array([list(r.items()) for r in part], pa.map_(pa.string(), pa.string()))], ["path", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, fields map<string,string>")


def parse_time(df: DataFrame, column: str, fmt: str | None = None, out: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows with a timestamp, one-row count of the rejected): epoch seconds, or a pattern with or without a zone."""
    c = F.col(column).cast("string")
    ts = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.timestamp_micros((c.try_cast("double") * 1_000_000).cast("long"))
    parsed = df.withColumn(out, ts)
    return parsed.where(F.col(out).isNotNull()), parsed.agg(F.count_if(F.col(out).isNull()).alias("rejected"))


def widen(df: DataFrame, fields: list[str], map_column: str = "fields") -> DataFrame:
    """Columns of a map-typed record; an absent field is null."""
    return df.select(*[F.col(map_column)[f].alias(f) for f in fields])

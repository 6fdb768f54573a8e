"""Points and results in files other than the store's own: CSV, JSON lines, raw binary records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import POINT_BYTES, invalid

COMMAND = T.StructType([T.StructField("command", T.StringType()), T.StructField("series", T.StringType()), T.StructField("window_size", T.LongType()), T.StructField("points", T.LongType())])


def read_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    """``timestamp,value`` with a header; lines that do not parse are passed over."""
    rows = spark.read.csv(path, schema="timestamp bigint, value double", header=True, mode="DROPMALFORMED")
    return rows.filter("timestamp IS NOT NULL AND value IS NOT NULL").select(F.lit(series).alias("series"), "timestamp", "value")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table; a path without files is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return spark.read.csv(path, schema=schema, header=True) if there else spark.createDataFrame([], schema)


def read_binary(spark: SparkSession, path: str, series: str) -> DataFrame:
    """Records of a 64-bit time and a double, little-endian; a torn last record is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = np.frombuffer(data, [("t", "<i8"), ("v", "<f8")], len(data) // POINT_BYTES)
                for at in range(0, len(rows), 65536):
                    part = rows[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(part["t"].copy()), pa.array(part["v"].copy())], names=["timestamp", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "timestamp bigint, value double").select(F.lit(series).alias("series"), "timestamp", "value")


def commands(lines: DataFrame, text: str = "value") -> DataFrame:
    """JSON commands with their defaults; one without a name is dropped."""
    c = F.from_json(F.col(text), COMMAND)
    return lines.select(c.alias("c")).filter("c.command IS NOT NULL AND length(c.command) > 0").select(
        F.col("c.command").alias("command"), "c.series", F.coalesce("c.window_size", F.lit(60_000)).alias("window_size"), F.coalesce("c.points", F.lit(1)).alias("points")
    )


def write_results(df: DataFrame, path: str, *, order: list[str] | None = None) -> None:
    """A small result table as one CSV file with a header."""
    if order is not None and not order:
        raise invalid("an order needs columns")
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)

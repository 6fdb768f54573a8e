"""Streams: ingest into Parquet with exactly-once batches, continuous windows, stateful alarms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reads import check_windows, largest, least, window_end
from tidemark.schema import POINTS


def source(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 64, schema=POINTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def ingest(points: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to root, partitioned by series; one folder for each batch, overwritten if the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("series").parquet(f"{root}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, root: str) -> DataFrame:
    schema = POINTS.fieldNames()
    return spark.read.schema("timestamp bigint, value double, batch bigint, series string").parquet(root).select(*schema)


def windows(points: DataFrame, start: int, end: int, size: int) -> DataFrame:
    """Anchored, clipped windows of every series as a streaming aggregate: late points always count."""
    check_windows(start, end, size)
    k = F.expr(f"(timestamp - {start}L) div {size}L")
    v = F.col("value")
    rows = points.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end)).withColumn("k", k)
    grouped = rows.groupBy("series", "k").agg(F.count(F.lit(1)).alias("count"), least(v).alias("min"), largest(v).alias("max"), F.avg(v).alias("avg"))
    begin = F.lit(start).cast("long") + F.col("k") * F.lit(size).cast("long")
    return grouped.select("series", begin.alias("window_start"), window_end(F.col("k"), start, end, size).alias("window_end"), "count", "min", "max", "avg")


def event_time(points: DataFrame, lateness: str | None = None) -> DataFrame:
    """Points with ``at`` as a timestamp (from microseconds), with a watermark if lateness is given."""
    out = points.withColumn("at", F.timestamp_micros("timestamp"))
    return out.withWatermark("at", lateness) if lateness else out


def sliding(points: DataFrame, length: str, slide: str) -> DataFrame:
    w = F.window("at", length, slide)
    return points.groupBy("series", w.alias("w")).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg")).select(
        "series", F.unix_micros("w.start").alias("window_start"), F.unix_micros("w.end").alias("window_end"), "count", "avg"
    )


def sessions(points: DataFrame, gap: str) -> DataFrame:
    w = F.session_window("at", gap)
    return points.groupBy("series", w.alias("w")).agg(F.count(F.lit(1)).alias("count"), F.max("value").alias("max")).select(
        "series", F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "count", "max"
    )


def spikes(points: DataFrame, limit: float, hold: int) -> DataFrame:
    """Points with a flag that stays up for ``hold`` points of a series after its value passed the limit."""

    def run(key, batches, state):
        left = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values("timestamp")
            flags = []
            for v in pdf["value"]:
                left = hold if v > limit else max(0, left - 1)
                flags.append(left > 0)
            yield pd.DataFrame({"series": pdf["series"], "timestamp": pdf["timestamp"], "value": pdf["value"], "raised": flags})
        state.update((left,))

    return points.groupBy("series").applyInPandasWithState(run, "series string, timestamp bigint, value double, raised boolean", "n long", "append", "NoTimeout")


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the streaming engine, as a table."""
    spark = df.sparkSession
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)

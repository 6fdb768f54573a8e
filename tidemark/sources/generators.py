"""Synthetic series, made in the executors from a row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import invalid

BASE = 1_710_000_000_000


def _i() -> Column:
    return F.col("i").cast("double")


#: Shapes of the benchmark datasets.
VALUES = {
    "linear": lambda seed: _i(),
    "smooth": lambda seed: 70 + F.sin(_i() * 0.001) + ((F.col("i") % 17) - 8) * 0.0001,
    "noisy": lambda seed: F.rand(seed),
    "step": lambda seed: 50 + (F.floor(F.col("i") / 1000) % 20).cast("double"),
    "constant": lambda seed: F.lit(42.0),
    "irregular": lambda seed: 65 + F.sin(_i() * 0.002),
    "bench_read": lambda seed: (F.col("i") % 1000) / 10,
    "bench_write": lambda seed: 20 + (F.col("i") % 100) * 0.01,
}

#: The station's sensors, their titles and units.
STATION = [
    ("air.temperature", "Temperature", "C"),
    ("air.humidity", "Humidity", "%"),
    ("air.pressure", "Pressure", "hPa"),
    ("wind.speed", "Wind", "m/s"),
    ("pm25.concentration", "PM2.5", "ug/m3"),
    ("battery.voltage", "Battery", "V"),
]


def generate(spark: SparkSession, kind: str, n: int, *, series: str = "bench.value", start: int = BASE, step: int = 1000, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n points of one shape; 'irregular' also jitters the time."""
    if kind not in VALUES:
        raise invalid(f"unknown dataset: {kind!r}")
    i = spark.range(0, n, 1, partitions).withColumnRenamed("id", "i") if partitions else spark.range(n).withColumnRenamed("id", "i")
    jitter = (F.col("i") % 11) * (F.col("i") % 11) * 37 if kind == "irregular" else F.lit(0)
    return i.select(
        F.lit(series).alias("series"), (F.lit(start) + F.col("i") * step + jitter).cast("long").alias("timestamp"), VALUES[kind](seed).cast("double").alias("value"), F.col("i").alias("seq")
    )


def station(spark: SparkSession, steps: int, *, start: int = BASE, step: int = 5000) -> DataFrame:
    """A weather station: every sensor at every step, each a slow wave about its usual level."""
    level = {"air.temperature": (18, 6), "air.humidity": (55, 12), "air.pressure": (1013, 4), "wind.speed": (4, 3), "pm25.concentration": (18, 9), "battery.voltage": (3.9, 0.2)}
    sensors = spark.createDataFrame([(s, float(level[s][0]), float(level[s][1]), k) for k, (s, _, _) in enumerate(STATION)], "series string, mid double, swing double, k int")
    return (
        spark.range(steps)
        .withColumnRenamed("id", "i")
        .crossJoin(F.broadcast(sensors))  # six rows
        .select(
            "series",
            (F.lit(start) + F.col("i") * step).alias("timestamp"),
            F.greatest(F.lit(0.0), F.col("mid") + F.col("swing") * F.sin(F.col("i") * 0.01 + F.col("k"))).alias("value"),
            F.col("i").alias("seq"),
        )
    )

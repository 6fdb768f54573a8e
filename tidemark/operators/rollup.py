"""Second-level results: roll-ups of windows, weighted means, tables of benchmark runs, series algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.catalog import BUCKET_ROWS, carried, own


def window_rollup(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Windows summed up: how many, their points, extremes, plain and weighted mean, first and last."""
    n = F.sum("count")
    columns = [
        F.count(F.lit(1)).alias("window_count"),
        n.alias("source_points"),
        ratio(n, F.count(F.lit(1))).alias("downsample_ratio"),
        F.min("min").alias("global_min"),
        F.max("max").alias("global_max"),
        F.avg("avg").alias("avg_of_avgs"),
        (F.sum(F.col("avg") * F.col("count")) / n).alias("weighted_avg"),
        F.min_by("avg", "window_start").alias("first_avg"),
        F.max_by("avg", "window_start").alias("last_avg"),
        F.min("window_start").alias("first_window"),
        F.max("window_start").alias("last_window"),
    ]
    return windows.groupBy(*by).agg(*columns) if by else windows.agg(*columns)


def weighted_average(groups: DataFrame, mean: str = "avg", weight: str = "count") -> DataFrame:
    return groups.agg((F.sum(F.col(mean) * F.col(weight)) / F.sum(weight)).alias("weighted_avg"), F.sum(weight).alias("points"))


def throughput(runs: DataFrame, amount: str, seconds: str) -> DataFrame:
    return runs.withColumn(f"{amount}_per_sec", ratio(F.col(amount).cast("double"), F.col(seconds).cast("double")))


def pivot_mean(rows: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """Mean of a value, a row for each ``row`` and a column for each of the given ``values``."""
    return rows.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def relative_to(rows: DataFrame, key: str, name: str, baseline: str, value: str) -> DataFrame:
    """Each value against the baseline's of its key: a / b and 1 - a / b, by one aggregation and no self-join."""
    base = F.max(F.when(F.col(name) == baseline, F.col(value))).over(Window.partitionBy(key))
    return rows.withColumn("baseline", base).withColumn("relative", F.col(value) / F.col("baseline")).withColumn("saving", 1 - F.col("relative"))


def names_by_group(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("names"))


def preferred(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def mean_ratio(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Mean over the common keys of a's value over b's."""
    joined = a.select(on, F.col(value).alias("x")).join(b.select(on, F.col(value).alias("y")), on)
    return joined.agg(F.avg(F.col("x") / F.col("y")).alias("mean_ratio"), F.count(F.lit(1)).alias("n"))


def deltas(points: DataFrame, order: str = "seq", rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Step of time from the point before, and the step's own change, within each series."""
    rows, w, _ = carried(points, order, 2, rows_per_bucket)
    one = rows.withColumn("delta", F.col("timestamp") - F.lag("timestamp").over(w))
    return own(one.withColumn("delta_of_delta", F.col("delta") - F.lag("delta").over(w)))


def value_changes(points: DataFrame, order: str = "seq", rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Whether a value differs from the one before in its series; the first one does."""
    rows, w, _ = carried(points, order, 1, rows_per_bucket)
    return own(rows.withColumn("changed", ~F.col("value").eqNullSafe(F.lag("value").over(w))))


def last_points(points: DataFrame, n: int, by: Sequence[str] = ("series",)) -> DataFrame:
    """The n latest points of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("timestamp"), F.desc("value"))
    return points.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_value(points: DataFrame, by: str = "series") -> DataFrame:
    """Time and value of the largest value of each group (the earliest of equals)."""
    best = F.max(F.struct("value", F.bitwise_not("timestamp").alias("t")))  # runs the other way, and cannot overflow
    return points.groupBy(by).agg(best.alias("b")).select(by, F.col("b.value").alias("value"), F.bitwise_not("b.t").alias("timestamp"))


def resets(points: DataFrame, order: str = "seq", rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Number of the run a counter is in; a run ends where the value falls."""
    rows, w, single = carried(points, order, 1, rows_per_bucket)
    fell = F.coalesce((F.col("value") < F.lag("value").over(w)).cast("long"), F.lit(0))
    marked = rows.withColumn("__fell", F.when(F.col("__ghost"), 0).otherwise(fell))
    counted = marked.withColumn("run", F.sum("__fell").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not single:
        earlier = F.sum("__n").over(Window.partitionBy("series").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        totals = marked.groupBy("series", "__b").agg(F.sum("__fell").alias("__n")).select("series", "__b", F.coalesce(earlier, F.lit(0)).alias("__earlier"))
        counted = counted.join(totals, ["series", "__b"]).withColumn("run", F.col("run") + F.col("__earlier")).drop("__earlier")
    return own(counted.drop("__fell"))


def missing(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    return wanted.join(present.select(on), on, "left_anti")

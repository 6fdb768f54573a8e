"""Range reads, aggregates over a range, and anchored tumbling windows.

All operators take any number of series at once: ``by`` names the columns that group.
Arguments are checked as Python integers before a plan is built; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import INT64_MAX, INT64_MIN, MAX_WINDOWS, Aggregate, invalid
from tidemark.sources.points import Points


def check_range(low: int, high: int) -> None:
    for x in (low, high):
        if isinstance(x, bool) or not isinstance(x, int) or not INT64_MIN <= x <= INT64_MAX:
            raise invalid("bounds must be 64-bit integers")
    if low > high:
        raise invalid("the range ends before it starts")


def check_windows(start: int, end: int, size: int) -> int:
    """Number of windows, empty ones included."""
    check_range(start, end)
    if isinstance(size, bool) or not isinstance(size, int) or not 0 < size <= INT64_MAX:
        raise invalid("the window size must be positive")
    if end - start > INT64_MAX:
        raise invalid("the range is too long")
    n = -(-(end - start) // size)
    if n > MAX_WINDOWS:
        raise invalid(f"more than {MAX_WINDOWS} windows")
    return n


def least(v: Column) -> Column:
    """Minimum that passes over NaN unless there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.max(v))


def largest(v: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v))


def total(v: Column, exact_scale: int | None = None) -> Column:
    """Sum; with a scale, exact for decimals of that scale and the same for any layout of the rows.

    NaN, the infinities and numbers too large for 18 digits make it a plain sum.
    """
    if exact_scale is None:
        return F.sum(v)
    limit = 10.0 ** (18 - exact_scale)
    fits = ~F.isnan(v) & (F.abs(v) < limit)
    exact = F.sum(F.when(fits, v).cast(f"decimal(18,{exact_scale})")).cast("double")
    return F.when(F.count_if(~fits) > 0, F.sum(v)).otherwise(exact)


def average(v: Column, exact_scale: int | None = None) -> Column:
    return F.avg(v) if exact_scale is None else total(v, exact_scale) / F.count(F.lit(1))


def measure(kind: Aggregate, v: Column, exact_scale: int | None = None) -> Column:
    return {
        Aggregate.MIN: lambda: least(v),
        Aggregate.MAX: lambda: largest(v),
        Aggregate.SUM: lambda: total(v, exact_scale),
        Aggregate.AVG: lambda: average(v, exact_scale),
        Aggregate.COUNT: lambda: F.count(F.lit(1)),
    }[kind]()


def read_range(points: Points, low: int, high: int, *, series: str | list[str] | None = None) -> DataFrame:
    """Points with low <= timestamp <= high."""
    check_range(low, high)
    return points.select(low, high, series=series)


def aggregate(
    points: Points, low: int, high: int, kinds: Sequence[Aggregate | str | int], *,
    series: str | list[str] | None = None, by: Sequence[str] = (), exact_scale: int | None = None,
) -> DataFrame:
    """One row (or one for each group) with a column for each kind of aggregate, over low..high inclusive.

    Without points the count is 0 and everything else null.
    """
    check_range(low, high)
    parsed = [Aggregate.of(k) for k in kinds]
    rows = points.select(low, high, series=series)
    columns = [measure(k, F.col("value"), exact_scale).alias(k.name.lower()) for k in parsed]
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def window_end(k: Column, start: int, end: int, size: int) -> Column:
    """End of window k, clipped to ``end`` without leaving 64 bits."""
    begin = F.lit(start).cast("long") + k * F.lit(size).cast("long")
    return F.when(F.lit(end).cast("long") - begin < size, F.lit(end).cast("long")).otherwise(begin + size)


def aggregate_windowed(
    points: Points, start: int, end: int, size: int, *,
    series: str | list[str] | None = None, by: Sequence[str] = (), exact_scale: int | None = None,
) -> DataFrame:
    """Non-empty tumbling windows over start <= timestamp < end, anchored at start, the last one clipped."""
    check_windows(start, end, size)
    rows = points.select(start, end, closed=False, series=series)
    k = F.expr(f"(timestamp - {start}L) div {size}L") if start != INT64_MIN else F.expr(f"(timestamp - ({start + 1}L - 1L)) div {size}L")
    grouped = rows.withColumn("k", k).groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("count"),
        least(F.col("value")).alias("min"),
        largest(F.col("value")).alias("max"),
        average(F.col("value"), exact_scale).alias("avg"),
    )
    begin = F.lit(start).cast("long") + F.col("k") * F.lit(size).cast("long")
    return grouped.select(*by, begin.alias("window_start"), window_end(F.col("k"), start, end, size).alias("window_end"), "count", "min", "max", "avg")


def first_points(points: Points, n: int, *, series: str | None = None) -> DataFrame:
    """The n earliest points."""
    return points.select(series=series).orderBy("timestamp").limit(n)


def recent(points: Points, length: int, *, by: Sequence[str] = ("series",)) -> DataFrame:
    """Points not older than ``length`` before the latest one of their group."""
    rows = points.select()
    last = rows.groupBy(*by).agg(F.max("timestamp").alias("last"))
    return rows.join(last, list(by)).filter(F.col("timestamp") >= F.col("last") - length).drop("last")

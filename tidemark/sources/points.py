"""Any table as points (series, timestamp, value).

Bounds on time are put on the raw column as literals of its own type, so that they reach
the Parquet scan as pushed filters; only then is the time made a number.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import INT64_MAX, invalid

EPOCH = datetime(1970, 1, 1)
PER_SECOND = {"us": 1_000_000, "ms": 1000, "s": 1}


@dataclass(frozen=True)
class Points:
    """A table and which of its columns name the series, the time and the value."""

    table: DataFrame
    series: str | Column = "series"
    time: str = "timestamp"
    value: str = "value"
    unit: str = "us"
    order: str | None = None  # a column in the order of arrival

    def __post_init__(self) -> None:
        if self.unit not in PER_SECOND:
            raise invalid(f"unknown unit: {self.unit!r}")

    @property
    def kind(self) -> str:
        return self.table.schema[self.time].dataType.simpleString()

    def timestamp(self) -> Column:
        t = F.col(self.time)
        if self.kind in ("timestamp", "timestamp_ntz", "date"):
            micros, n = F.unix_micros(t.cast("timestamp")), 1_000_000 // PER_SECOND[self.unit]
            return micros if n == 1 else F.call_function("div", micros - F.pmod(micros, F.lit(n)), F.lit(n))
        return t.cast("long")

    def literal(self, at: int) -> Column | None:
        """A moment as a literal of the raw column's type, a date being the first one not before it; None where that type cannot say it."""
        if self.kind not in ("timestamp", "timestamp_ntz", "date"):
            return F.lit(at).cast("long")
        try:
            moment = EPOCH + timedelta(microseconds=at * (1_000_000 // PER_SECOND[self.unit]))
            if self.kind == "date":
                day = moment.date()
                return F.lit((day if moment == EPOCH + (day - EPOCH.date()) else day + timedelta(days=1)).isoformat()).cast("date")
        except OverflowError:
            return None
        return F.lit(moment.isoformat(sep=" ")).cast(self.kind)

    def select(self, low: int | None = None, high: int | None = None, *, closed: bool = True, series: str | list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Points from ``low`` to ``high`` (exclusive unless closed), of one, some or all series."""
        name = F.col(self.series) if isinstance(self.series, str) else self.series
        df = self.table
        if series is not None:
            df = df.filter(name == series if isinstance(series, str) else name.isin(list(series)))
        raw, number = F.col(self.time), self.timestamp()
        if low is not None:
            bound = self.literal(low)
            df = df.filter(raw >= bound if bound is not None else number >= low)
        if high is not None:
            # up to high, included, is before high + 1 in units of the number; the raw column may be finer
            after = high + 1 if closed else high
            bound = self.literal(after) if after <= INT64_MAX else None
            df = df.filter(raw < bound if bound is not None else number <= high if closed else number < high)
        order = [F.col(self.order).alias("seq")] if self.order else []
        return df.select(name.cast("string").alias("series"), number.alias("timestamp"), F.col(self.value).cast("double").alias("value"), *order, *keep)


def events(df: DataFrame, series: str = "event_type") -> Points:
    return Points(df, series, "ts", "value", order="event_id")


def orders(df: DataFrame) -> Points:
    return Points(df, "o_orderpriority", "o_orderdate", "o_totalprice", order="o_orderkey")


def lineitem(df: DataFrame) -> Points:
    return Points(df, "l_returnflag", "l_shipdate", "l_extendedprice")

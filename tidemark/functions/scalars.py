"""Column functions: names, files, numbers, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import MAX_NAME_BYTES, POINT_BYTES


def valid_name(name: str | None) -> bool:
    """Whether a string may name a series.  '.' and '..' may not: they would be folders."""
    if not isinstance(name, str) or name in (".", "..") or "\0" in name:
        return False
    return 1 <= len(name.encode("utf-8", "surrogatepass")) <= MAX_NAME_BYTES and not re.search(r"[/\\]", name)


def valid_name_column(c: Column) -> Column:
    size = F.octet_length(c)
    return F.coalesce((size >= 1) & (size <= MAX_NAME_BYTES) & ~c.rlike(r"[/\\]") & ~c.isin(".", ".."), F.lit(False))


def file_name(c: Column) -> Column:
    """A series name as the name of its CSV file, for ASCII names."""
    safe = F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.concat(F.when(F.length(safe) > 0, safe).otherwise("series"), F.lit(".csv"))


def file_name_of(name: str) -> str:
    """As ``file_name``, byte by byte for any name."""
    safe = "".join(chr(b) if re.match(rb"[A-Za-z0-9_-]", bytes([b])) else "_" for b in name.encode())
    return (safe or "series") + ".csv"


def safe_csv_name(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]+\.csv$"), F.lit(False))


def segment_file(c: Column) -> Column:
    return F.format_string("segment_%06d.tse", c)


def segment_id(c: Column) -> Column:
    """The number in a segment's file name; null unless formatting it gives the name back."""
    number = F.regexp_extract(c, r"^segment_([0-9]{6,9})\.tse$", 1)
    parsed = F.when(F.length(number) > 0, number).cast("int")
    return F.when(segment_file(parsed) == c, parsed)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def raw_bytes(n: Column) -> Column:
    return n * F.lit(POINT_BYTES)


def number_or_null(c: Column) -> Column:
    return c.try_cast("double")


def scaled(v: Column, low: Column, high: Column) -> Column:
    """Place between the least and the largest value, for a small chart."""
    return (v - low) / F.greatest(F.lit(1.0), high - low)


def percent(part: Column, whole: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), ratio(part * 100.0, whole)))


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def clock(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "HH:mm:ss")


#: Limits of a station's sensors and their labels, most severe first.
ALERTS = {
    "pm25.concentration": [(">", 75.0, "high"), (">", 35.0, "elevated")],
    "battery.voltage": [("<", 3.4, "low")],
    "wind.speed": [(">", 8.0, "strong")],
    "air.temperature": [(">", 25.0, "warm"), ("<", 5.0, "cold")],
}


def label(v: Column, rules: list[tuple[str, float, str]], otherwise: str = "normal") -> Column:
    out = None
    for sign, limit, name in rules:
        hit = v > limit if sign == ">" else v < limit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def format_17g(v: float) -> str:
    """C's %.17g."""
    return "%.17g" % v

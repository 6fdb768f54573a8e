"""Schemas, enumerations and errors shared by the engine."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

POINTS = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)
#: As stored: with the arrival number of a point within its series and the segment that holds it.
STORED = T.StructType(
    [
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("series", T.StringType(), False),
        T.StructField("segment_id", T.IntegerType(), False),
    ]
)

#: Sizes and limits of the data model.
POINT_BYTES = 16
BLOCK_POINTS = 16384
MAX_WINDOWS = 1_000_000
MAX_NAME_BYTES = 255
INT64_MAX, INT64_MIN = 2**63 - 1, -(2**63)


class Aggregate(IntEnum):
    MIN = 0
    MAX = 1
    SUM = 2
    AVG = 3
    COUNT = 4

    @classmethod
    def of(cls, value) -> Aggregate:
        return _parse(cls, value, "aggregate type")


class Durability(IntEnum):
    FAST = 0
    BALANCED = 1
    STRICT = 2

    @classmethod
    def of(cls, value) -> Durability:
        return _parse(cls, value, "durability mode")


class Status(IntEnum):
    OK = 0
    INVALID_ARGUMENT = -1
    OUT_OF_MEMORY = -2
    IO = -3
    NOT_FOUND = -4
    CORRUPT = -5
    EXISTS = -6
    QUOTA_EXCEEDED = -7


MESSAGES = {
    Status.OK: "ok",
    Status.INVALID_ARGUMENT: "invalid argument",
    Status.OUT_OF_MEMORY: "out of memory",
    Status.IO: "I/O error",
    Status.NOT_FOUND: "not found",
    Status.CORRUPT: "corrupt data",
    Status.EXISTS: "already exists",
    Status.QUOTA_EXCEEDED: "disk quota exceeded",
}


class TidemarkError(Exception):
    """An engine error with its status code."""

    def __init__(self, code: int, message: str | None = None):
        self.code = int(code)
        self.message = message or MESSAGES[Status(code)]
        super().__init__(f"{self.message} ({self.code})")


def invalid(message: str) -> TidemarkError:
    return TidemarkError(Status.INVALID_ARGUMENT, message)


def _parse(cls, value, what: str):
    if isinstance(value, str):
        try:
            return cls[value.strip().upper()]
        except KeyError:
            raise invalid(f"unknown {what}: {value!r}") from None
    try:
        return cls(value)
    except (ValueError, TypeError):
        raise invalid(f"unknown {what}: {value!r}") from None

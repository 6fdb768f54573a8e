"""What the corpus operators share: table access, words, id hashes, cut lineage."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters to lower case, every other ASCII character that is not a digit to a space.
WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words, in lower case, in the syntax of Python, Java and RE2, and what separates them.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return encode(text).translate(WORD_BYTES).split()


def space_words(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z in lower case."""
    return encode(text).lower().split()


def crc_mod(doc_id: object, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def ascii_lower(column) -> F.Column:
    return F.translate(column, UPPER, LOWER)


def pieces(column, gaps: str) -> F.Column:
    """What stands between the gaps; splitting costs Spark a tenth of extracting all matches."""
    return F.array_remove(F.split(column, gaps), "")


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row's texts, binary values and lists."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that Python objects of a few hundred texts, or of about ``size`` bytes, live at once."""
    ends = np.cumsum(row_bytes(batch))
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        end = min(at + rows, max(full, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; on one machine the warehouse serves where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder, so that a lost executor loses no result."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def parallel(df: DataFrame, min_rows_per_task: int = 400) -> DataFrame:
    """Deal a table that fits in fewer splits than there are cores to all of them.

    Large inputs keep the scan's own splits: a shuffle of whole texts buys nothing there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df if splits >= cores else df.repartition(cores)

"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken by falling length.  Each goes into the open bin it leaves the
least room in; if none has room, a bin is opened.  Its size is chosen jointly over
all permitted lengths: for each one the histogram of the pieces still to come is
poured in greedily, and the size with the least cost for a token placed wins.  At
the end every bin shrinks to the smallest permitted length that holds its contents.
A text longer than the largest length is cut into pieces that all stay.

Pieces are dealt by a hash of id and piece to shards of about ``shard_rows``
documents and each shard packs on its own, so memory is bounded, a hot source or
language cannot gather, and a lost task is simply run again.  Only id, piece and
length cross the network.

Defined results: a null or empty text is a piece of length 1 (its end marker);
repeated rows are packed each on its own; ties of length go by id, then piece; an
empty table gives no bins; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, table
from .common import pieces as pieces_of

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its tokens, in tokens: padding to the next step, attention set-up.
OVERHEAD = 16
SHARD_ROWS = 20_000


def words_and_end(text) -> F.Column:
    """Length of a text: words between ASCII white space, plus one end marker."""
    return F.coalesce(F.size(pieces_of(text, SPACE_PATTERN)), F.lit(0)).cast("long") + F.lit(1)


def fill(room: int, sizes: list[int], left: np.ndarray) -> int:
    """Tokens that the pieces still to come would put into ``room``, largest first."""
    put, at = 0, bisect_right(sizes, room) - 1
    while at >= 0 and room >= sizes[0]:
        n = min(int(left[at]), room // sizes[at])
        if n:
            put += n * sizes[at]
            room -= n * sizes[at]
        at = min(at - 1, bisect_right(sizes, room) - 1)
    return put


def pack_lengths(
    lengths: Sequence[int], capacities: Sequence[int] = LENGTHS, overhead: int = OVERHEAD
) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece (in the given order) and the final length of each bin.

    ``lengths`` may come in any order and none may exceed the largest capacity.
    """
    capacities = sorted(capacities)
    lengths = np.asarray(lengths, dtype=np.int64)
    bins = np.zeros(len(lengths), dtype=np.int64)
    sizes, counts = np.unique(lengths, return_counts=True)
    sizes, left = sizes.tolist(), counts.copy()
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        left[bisect_left(sizes, size)] -= 1
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, best = 0, None
            for c in capacities:
                if c >= size:
                    price = (c + overhead) / (size + fill(c - size, sizes, left))
                    if best is None or price < best:
                        room, best = c, price
            b = len(used)
            used.append(0)
        bins[i] = b
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    final = np.asarray(capacities, dtype=np.int64)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, final


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length=None,
    capacities: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row for each piece: its bin, the bin's final length, and its place in text and bin.

    ``length`` is a column expression; by default words plus an end marker.  Bins are
    numbered shard * 2**32 + bin.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    shards = max(1, -(-docs.count() // shard_rows))
    size = words_and_end(F.col(text_col)) if length is None else length.cast("long")
    pieces = (
        docs.select(F.col(id_col).alias("doc_id"), F.greatest(size, F.lit(1)).alias("total"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {largest}"))))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * largest).alias("start"),
            F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).alias("length"),
            F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("long").alias("shard"),
        )
    )
    caps = tuple(capacities)

    def one_shard(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        b, final = pack_lengths(shard["length"].to_numpy(), caps, overhead)
        lengths = shard["length"].to_numpy()
        order = np.argsort(b, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(b[order], b[order])
        offset = np.empty(len(b), np.int64)
        offset[order] = before - before[first]
        kept = [shard[c] for c in ("doc_id", "piece", "start", "length")]
        new = [pa.array(shard["shard"].to_numpy() * (1 << 32) + b), pa.array(final[b]), pa.array(offset)]
        return pa.table(kept + new, names=["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"])

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, piece long, start long, length long, bin_id long, capacity long, offset long"
    # as many partitions as shards: by bytes they would be joined to a few, but packing costs time
    return pieces.repartition(shards, "shard").groupBy("shard").applyInArrow(one_shard, ddl)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row for each bin: its length, the tokens used, and its pieces in order."""
    return pieces.groupBy("bin_id", "capacity").agg(
        F.sum("length").alias("used"),
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

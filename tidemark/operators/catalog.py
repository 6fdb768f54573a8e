"""What there is: series, their statistics, blocks and segments, and what policies would delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio, raw_bytes
from tidemark.operators.reads import largest, least, total
from tidemark.schema import BLOCK_POINTS


#: Rows of all series together that one task may rank.
BUCKET_ROWS = 4_000_000


def bucketed(points: DataFrame, order: str, rows_per_bucket: int) -> tuple[DataFrame, bool]:
    """Points with ``__b``, and whether that is one bucket only: buckets of the order that rise with it, of about as many rows each, whatever its distribution."""
    n = -(-points.count() // rows_per_bucket)
    if n <= 1:
        return points.withColumn("__b", F.lit(0)), True
    cuts = sorted(set(points.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / n for k in range(1, n)], min(0.01, 0.2 / n))))
    edges = points.sparkSession.createDataFrame([(cuts,)], "__cuts array<double>")  # one row, a number for each bucket
    at = F.expr(f"aggregate(sequence(1, {max(1, len(cuts)).bit_length()}), named_struct('a', 0, 'b', size(__cuts)), (s, _) -> "
                f"if(s.a >= s.b, s, if(__cuts[(s.a + s.b) div 2] <= cast(`{order}` as double), named_struct('a', cast((s.a + s.b) div 2 + 1 as int), 'b', s.b), named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)))), s -> s.a)")  # fmt: skip
    return points.crossJoin(F.broadcast(edges)).withColumn("__b", at).drop("__cuts"), False


def carried(points: DataFrame, order: str, k: int, rows_per_bucket: int) -> tuple[DataFrame, WindowSpec, bool]:
    """Points by bucket with the k rows before each bucket as ghosts, the window in which a row sees those before it, and
    whether there is one bucket only.

    So what looks k rows back never needs a whole series in one task; ``own`` drops the ghosts.
    """
    rows, single = bucketed(points, order, rows_per_bucket)
    rows, w = rows.withColumn("__ghost", F.lit(False)), Window.partitionBy("series", "__b")
    if single:
        return rows, w.orderBy(order), True
    tails = rows.withColumn("__r", F.row_number().over(w.orderBy(F.desc(order)))).filter(F.col("__r") <= k).drop("__r")
    series = Window.partitionBy("series").orderBy("__b", order)  # k rows of each bucket
    ahead = F.array_distinct(F.array_compact(F.array(*[F.lead("__b", i).over(series) for i in range(1, k + 1)])))
    ghosts = tails.withColumn("__to", ahead).withColumn("__to", F.explode("__to")).filter("__to <> __b")
    ghosts = ghosts.withColumn("__b", F.col("__to")).drop("__to").withColumn("__ghost", F.lit(True))
    return rows.unionByName(ghosts), w.orderBy(order), False


def own(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("__ghost")).drop("__b", "__ghost")


def place_in_series(points: DataFrame, order: str = "seq", rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Points with ``place``: their number, from 0, by a numeric order within their series.

    A row's place is its rank in its bucket of the order after the rows of its series' earlier
    buckets, so no task ranks more than about ``rows_per_bucket`` rows.
    """
    rows, single = bucketed(points, order, rows_per_bucket)
    rank = F.row_number().over(Window.partitionBy("series", "__b").orderBy(order)) - 1
    if single:
        return rows.withColumn("place", rank.cast("long")).drop("__b")
    before = F.sum("__c").over(Window.partitionBy("series").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("series", "__b").agg(F.count(F.lit(1)).alias("__c")).select("series", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(counts, ["series", "__b"]).withColumn("place", (F.col("__before") + rank).cast("long")).drop("__b", "__before")


def numbered(points: DataFrame, block_points: int = BLOCK_POINTS, blocks_per_segment: int = 4, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Points with block and segment numbers by order of arrival (``seq``) within their series."""
    placed = place_in_series(points, "seq", rows_per_bucket)
    return placed.withColumn("block_id", F.expr(f"place div {block_points}")).withColumn("segment_id", F.expr(f"cast(block_id div {blocks_per_segment} + 1 as int)")).drop("place")


def block_stats(points: DataFrame, exact_scale: int | None = None) -> DataFrame:
    """One row for each block with the partial aggregates that can answer queries over it."""
    v = F.col("value")
    return points.groupBy("series", "segment_id", "block_id").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        least(v).alias("min_value"),
        largest(v).alias("max_value"),
        total(v, exact_scale).alias("sum_value"),
    )


def aggregate_from_blocks(blocks: DataFrame, points: DataFrame, low: int, high: int) -> DataFrame:
    """count, min, max, sum of each series over low..high: whole blocks by their statistics, the rest by points.

    A block that lies in the range is never read; only blocks cut by a bound are.
    """
    inside = (F.col("min_timestamp") >= low) & (F.col("max_timestamp") <= high)
    meets = (F.col("max_timestamp") >= low) & (F.col("min_timestamp") <= high)
    whole = blocks.filter(inside).select("series", F.col("point_count").alias("n"), F.col("min_value").alias("a"), F.col("max_value").alias("b"), F.col("sum_value").alias("s"))
    cut = blocks.filter(meets & ~inside).select("series", "segment_id", "block_id")
    part = points.filter(F.col("timestamp").between(low, high)).join(cut, ["series", "segment_id", "block_id"], "left_semi")
    v = F.col("value")
    part = part.groupBy("series").agg(F.count(F.lit(1)).alias("n"), least(v).alias("a"), largest(v).alias("b"), F.sum(v).alias("s"))
    return whole.unionByName(part).groupBy("series").agg(F.sum("n").alias("count"), least(F.col("a")).alias("min"), largest(F.col("b")).alias("max"), F.sum("s").alias("sum"))


def segment_bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("series", "segment_id").agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.count_distinct("block_id").alias("block_count"),
        F.count(F.lit(1)).alias("point_count"),
    )


def list_series(points: DataFrame) -> DataFrame:
    return points.groupBy(F.col("series").alias("name")).agg(
        F.count(F.lit(1)).alias("total_points"),
        F.count_distinct("segment_id").alias("segment_count"),
        F.count_distinct("block_id").alias("block_count"),
    )


def series_stats(points: DataFrame) -> DataFrame:
    """Logical statistics of each series: points, time range, raw size."""
    n = F.count(F.lit(1))
    return points.groupBy("series").agg(
        n.alias("total_indexed_points"),
        F.lit(True).alias("has_time_range"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        raw_bytes(n).alias("raw_size_estimate_bytes"),
    )


def expired(segments: DataFrame, before: int) -> DataFrame:
    """Segments that lie wholly before a time: those that retention deletes."""
    return segments.filter(F.col("max_timestamp") < before)


def survivors(points: DataFrame, segments: DataFrame, before: int) -> DataFrame:
    """Points left after retention; a segment that reaches the time keeps all its points."""
    return points.join(expired(segments, before).select("series", "segment_id"), ["series", "segment_id"], "left_anti")


def quota_victims(segments: DataFrame, size: str, quota: int | Column) -> DataFrame:
    """Sealed segments deleted, oldest first, until the total size fits: all whose predecessors do not suffice.

    The quota is a number or an aggregate over the segments.  The last segment of a series is never deleted.  The running sum is over segments, a
    table that holds one row for some ten thousand points.
    """
    sealed = segments.withColumn("__last", F.max("segment_id").over(Window.partitionBy("series")))
    excess = segments.agg((F.sum(size) - quota).alias("__excess"))
    order = Window.orderBy("max_timestamp", "series", "segment_id").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(size).over(order), F.lit(0))
    return (
        sealed.filter(F.col("segment_id") < F.col("__last"))
        .withColumn("__gone", gone)
        .crossJoin(F.broadcast(excess))  # one row
        .filter(F.col("__gone") < F.col("__excess"))
        .drop("__last", "__gone", "__excess")
    )


def segment_status(segments: DataFrame, before: int) -> DataFrame:
    last = F.max("segment_id").over(Window.partitionBy("series"))
    state = F.when(F.col("segment_id") == last, "active").when(F.col("max_timestamp") < before, "old").otherwise("sealed")
    return segments.withColumn("status", state)


def storage_totals(catalog: DataFrame) -> DataFrame:
    """Totals over all series of (total_points, compressed_size_bytes)."""
    raw, packed, n = F.sum(raw_bytes(F.col("total_points"))), F.sum("compressed_size_bytes"), F.sum("total_points")
    return catalog.agg(
        F.count(F.lit(1)).alias("series_count"),
        n.alias("total_points"),
        raw.alias("raw_size_bytes"),
        packed.alias("compressed_size_bytes"),
        ratio(raw, packed).alias("compression_ratio"),
        ratio(packed, n).alias("bytes_per_point"),
    )

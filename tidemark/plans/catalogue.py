"""The registered queries: every operator bound to the supplied tables, with its oracle SQL.

Sums and means over two-decimal values accumulate decimals on both sides (``EXACT``), so
that they agree whatever the layout of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import catalog, reads, rollup
from tidemark.sources import generators
from tidemark.sources.points import Points, events, lineitem, orders
from tidemark.streaming import ingest

EXACT = 2
DAY = 86_400_000_000
HOUR = DAY // 24
#: 2024-01-01 in microseconds, the first day of the events, and the last window's clipped end.
START = 1_704_067_200_000_000
END = START + 29 * DAY - HOUR
BLOCK, PER_SEGMENT = 64, 4

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, d: str, series: str = "event_type") -> Points:
    return events(table(spark, d, "events"), series)


def od(spark: SparkSession, d: str) -> Points:
    return orders(table(spark, d, "orders"))


def li(spark: SparkSession, d: str) -> Points:
    return lineitem(table(spark, d, "lineitem"))


#: The same bindings in DuckDB.
EVENTS = "(SELECT event_type AS series, epoch_us(ts) AS t, value AS v, event_id AS seq, user_id FROM events)"
ORDERS = "(SELECT o_orderpriority AS series, epoch_us(o_orderdate) AS t, o_totalprice AS v FROM orders)"
LINEITEM = "(SELECT l_returnflag AS series, epoch_us(l_shipdate) AS t, l_extendedprice AS v FROM lineitem)"
SUM = "CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE)"
AVG = f"{SUM} / count(*)"


def windowed_sql(source: str, start: int, end: int, size: int, *, by: str = "", where: str = "true") -> str:
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}{start} + k * {size} AS window_start, CASE WHEN {end} - ({start} + k * {size}) < {size} THEN {end} ELSE {start} + (k + 1) * {size} END AS window_end,
       count(*) AS count, min(v) AS min, max(v) AS max, {AVG} AS avg
FROM (SELECT *, (t - ({start})) // {size} AS k FROM {source} WHERE t >= {start} AND t < {end} AND {where}) GROUP BY {lead}k"""


def windowed(points, start: int, end: int, size: int, **options):
    return reads.aggregate_windowed(points, start, end, size, exact_scale=EXACT, **options)


# windows

W6 = 6 * HOUR


@query(windowed_sql(EVENTS, START, END, W6, where="series = 'click'"))
def window_events(spark, d):
    return windowed(ev(spark, d), START, END, W6, series="click")


@query(windowed_sql(EVENTS, START, END, W6, by="series"))
def window_events_multi(spark, d):
    return windowed(ev(spark, d), START, END, W6, by=["series"])


@query(windowed_sql("(SELECT CAST(user_id AS VARCHAR) AS series, t, v FROM " + EVENTS + ")", START, END, DAY, by="series"))
def window_events_by_user(spark, d):
    return windowed(ev(spark, d, "user_id"), START, END, DAY, by=["series"])


LI_START, LI_END = 694_224_000_000_000, 915_148_800_000_000  # 1992 to 1999


@query(windowed_sql(LINEITEM, LI_START, LI_END, 90 * DAY, by="series"))
def window_lineitem_90d(spark, d):
    return windowed(li(spark, d), LI_START, LI_END, 90 * DAY, by=["series"])


@query(windowed_sql(ORDERS, LI_START, LI_END, 30 * DAY, by="series"))
def window_orders_30d(spark, d):
    return windowed(od(spark, d), LI_START, LI_END, 30 * DAY, by=["series"])


@query(windowed_sql(EVENTS, START + 12_345_678, START + 9 * DAY + 77, 7_777_777_777, by="series"))
def window_unaligned(spark, d):
    return windowed(ev(spark, d), START + 12_345_678, START + 9 * DAY + 77, 7_777_777_777, by=["series"])


@query(windowed_sql(EVENTS, -5 * DAY, START + 3 * DAY, 7 * DAY))
def window_negative_start(spark, d):
    return windowed(ev(spark, d), -5 * DAY, START + 3 * DAY, 7 * DAY)


@query(windowed_sql(EVENTS, START, END, END - START, by="series"))
def window_single(spark, d):
    return windowed(ev(spark, d), START, END, END - START, by=["series"])


@query(windowed_sql(EVENTS, START, END, HOUR, where="user_id = 7"))
def window_sparse_user(spark, d):
    return windowed(ev(spark, d, "user_id"), START, END, HOUR, series="7")


@query(windowed_sql(EVENTS, START, START, HOUR))
def window_empty_range(spark, d):
    return windowed(ev(spark, d), START, START, HOUR)


@query(f"WITH b AS (SELECT series, min(t) AS a, max(t) + 1 AS z FROM {EVENTS} GROUP BY 1) SELECT series, a + k * {DAY} AS window_start, least(a + (k + 1) * {DAY}, z) AS window_end, count(*) AS count, min(v) AS min, max(v) AS max FROM (SELECT series, a, z, v, (t - a) // {DAY} AS k FROM {EVENTS} JOIN b USING (series)) GROUP BY series, a, z, k")
def window_full_extent(spark, d):
    """Windows anchored at each series' first point and clipped after its last."""
    rows = ev(spark, d).select()
    extent = rows.groupBy("series").agg(F.min("timestamp").alias("a"), (F.max("timestamp") + 1).alias("z"))
    rows = rows.join(extent, "series").withColumn("k", F.expr(f"(timestamp - a) div {DAY}L"))
    out = rows.groupBy("series", "a", "z", "k").agg(F.count(F.lit(1)).alias("count"), reads.least(F.col("value")).alias("min"), reads.largest(F.col("value")).alias("max"))
    return out.select("series", (F.col("a") + F.col("k") * DAY).alias("window_start"), F.least(F.col("a") + (F.col("k") + 1) * DAY, "z").alias("window_end"), "count", "min", "max")


# range reads

A, B = START + 3 * DAY, START + 4 * DAY


@query(f"SELECT series, t AS timestamp, v AS value FROM {EVENTS} WHERE t BETWEEN {A} AND {B}")
def range_events(spark, d):
    return reads.read_range(ev(spark, d), A, B).drop("seq")


@query(f"SELECT series, t AS timestamp, v AS value FROM {EVENTS} WHERE t BETWEEN {A} AND {B} AND series = 'purchase'")
def range_one_series(spark, d):
    return reads.read_range(ev(spark, d), A, B, series="purchase").drop("seq")


@query(f"SELECT series, t AS timestamp, v AS value FROM {EVENTS} WHERE t = (SELECT min(t) FROM {EVENTS})")
def range_point(spark, d):
    points = ev(spark, d)
    first = points.select().agg(F.min("timestamp").alias("timestamp"))
    return points.select().join(F.broadcast(first), "timestamp", "left_semi").select("series", "timestamp", "value")  # one row


@query(f"SELECT count(*) AS count FROM {EVENTS} WHERE t BETWEEN 1 AND 2")
def range_empty_count(spark, d):
    return reads.read_range(ev(spark, d), 1, 2).agg(F.count(F.lit(1)).alias("count"))


@query(f"SELECT count(*) AS points_read, {SUM} AS value_sum FROM {LINEITEM} WHERE t BETWEEN {LI_START} AND {LI_END}")
def range_read_accumulate(spark, d):
    rows = reads.read_range(li(spark, d), LI_START, LI_END)
    return rows.agg(F.count(F.lit(1)).alias("points_read"), reads.total(F.col("value"), EXACT).alias("value_sum"))


@query(f"SELECT series, t AS timestamp, v AS value FROM {ORDERS} WHERE t >= 820454400000000 AND t < 823132800000000")
def range_half_open_orders(spark, d):
    return od(spark, d).select(820_454_400_000_000, 823_132_800_000_000, closed=False).drop("seq")


# aggregates


def _aggregate(kind: str):
    def run(spark, d):
        return reads.aggregate(ev(spark, d), A, B, [kind], by=["series"], exact_scale=EXACT)

    expression = {"min": "min(v)", "max": "max(v)", "sum": SUM, "avg": AVG, "count": "count(*)"}[kind]
    query(f"SELECT series, {expression} AS {kind} FROM {EVENTS} WHERE t BETWEEN {A} AND {B} GROUP BY 1", f"agg_{kind}_events")(run)


for _kind in ("min", "max", "sum", "avg", "count"):
    _aggregate(_kind)


@query(f"SELECT min(v) AS min, max(v) AS max FROM {ORDERS}")
def agg_min_max_orders(spark, d):
    return reads.aggregate(od(spark, d), -(2**63), 2**63 - 1, ["min", "max"])


@query(f"SELECT count(*) AS count, min(v) AS min, max(v) AS max, {SUM} AS sum, {AVG} AS avg FROM {LINEITEM} WHERE series = 'R' AND t BETWEEN {LI_START} AND {LI_END}")
def agg_all_one_series(spark, d):
    return reads.aggregate(li(spark, d), LI_START, LI_END, ["count", "min", "max", "sum", "avg"], series="R", exact_scale=EXACT)


@query(f"SELECT count(*) AS count, min(v) AS min FROM {EVENTS} WHERE t < 0")
def agg_count_empty(spark, d):
    return reads.aggregate(ev(spark, d), -10, -1, ["count", "min"])


@query(f"SELECT coalesce({AVG}, 0) AS avg FROM {EVENTS} WHERE t < 0")
def agg_avg_or_zero(spark, d):
    return ev(spark, d).select(-10, -1).agg(F.coalesce(reads.total(F.col("value"), EXACT) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("avg"))


@query("SELECT 0 AS k, CAST(count(*) AS BIGINT) AS n, min(v) AS min, max(v) AS max FROM (SELECT CASE WHEN seq % 10 = 0 THEN NULL ELSE v END AS v FROM " + EVENTS + ") WHERE true GROUP BY 1")
def agg_nan_policy(spark, d):
    """Every tenth value is NaN: extremes pass over it, the count does not."""
    rows = ev(spark, d).select().withColumn("value", F.when(F.col("seq") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rows.groupBy(F.lit(0).alias("k")).agg(F.count(F.lit(1)).alias("n"), reads.least(F.col("value")).alias("min"), reads.largest(F.col("value")).alias("max"))


# catalog, blocks, segments, policies


def blocks_of(spark, d) -> DataFrame:
    return catalog.numbered(ev(spark, d).select(), BLOCK, PER_SEGMENT)


NUMBERED = f"(SELECT *, b // {PER_SEGMENT} + 1 AS g FROM (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY seq) - 1) // {BLOCK} AS b FROM {EVENTS}))"
SEGMENTS = f"(SELECT series, CAST(g AS INTEGER) AS segment_id, min(t) AS min_timestamp, max(t) AS max_timestamp, count(DISTINCT b) AS block_count, count(*) AS point_count FROM {NUMBERED} GROUP BY 1, 2)"
CUTOFF = START + 12 * DAY


@query(f"SELECT series AS name, count(*) AS total_points, count(DISTINCT g) AS segment_count, count(DISTINCT b) AS block_count FROM {NUMBERED} GROUP BY 1")
def series_list(spark, d):
    return catalog.list_series(blocks_of(spark, d))


@query(f"SELECT series, count(*) AS total_indexed_points, true AS has_time_range, min(t) AS min_timestamp, max(t) AS max_timestamp, count(*) * 16 AS raw_size_estimate_bytes FROM {EVENTS} GROUP BY 1")
def series_stats_time_range(spark, d):
    return catalog.series_stats(ev(spark, d).select())


@query(f"SELECT series, CAST(g AS INTEGER) AS segment_id, b AS block_id, count(*) AS point_count, min(t) AS min_timestamp, max(t) AS max_timestamp, min(v) AS min_value, max(v) AS max_value, {SUM} AS sum_value FROM {NUMBERED} GROUP BY 1, 2, 3")
def block_stats_events(spark, d):
    return catalog.block_stats(blocks_of(spark, d), EXACT)


@query(f"SELECT series, CAST(count(*) AS BIGINT) AS count, min(v) AS min, max(v) AS max, round({SUM}, 2) AS sum FROM {EVENTS} WHERE t BETWEEN {A} AND {CUTOFF} GROUP BY 1")
def agg_from_block_stats(spark, d):
    """Whole blocks from their statistics, cut blocks from their points."""
    points = blocks_of(spark, d)
    out = catalog.aggregate_from_blocks(catalog.block_stats(points), points, A, CUTOFF)
    return out.select("series", "count", "min", "max", F.round("sum", 2).alias("sum"))


@query(f"SELECT * FROM {SEGMENTS}")
def segment_bounds(spark, d):
    return catalog.segment_bounds(blocks_of(spark, d))


@query(f"SELECT series, segment_id, max_timestamp FROM {SEGMENTS} WHERE max_timestamp < {CUTOFF}")
def retention_segments(spark, d):
    return catalog.expired(catalog.segment_bounds(blocks_of(spark, d)), CUTOFF).select("series", "segment_id", "max_timestamp")


@query(f"SELECT n.series, count(*) AS points, min(t) AS min_timestamp FROM {NUMBERED} n JOIN {SEGMENTS} s ON s.series = n.series AND s.segment_id = n.g WHERE max_timestamp >= {CUTOFF} GROUP BY 1")
def retention_survivors(spark, d):
    points = blocks_of(spark, d)
    left = catalog.survivors(points, catalog.segment_bounds(points), CUTOFF)
    return left.groupBy("series").agg(F.count(F.lit(1)).alias("points"), F.min("timestamp").alias("min_timestamp"))


@query(
    f"""WITH s AS (SELECT *, point_count * 16 AS bytes FROM {SEGMENTS}), x AS (SELECT sum(bytes) - sum(bytes) // 2 AS excess FROM s),
    o AS (SELECT *, max(segment_id) OVER (PARTITION BY series) AS last FROM s),
    r AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY max_timestamp, series, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM o WHERE segment_id < last)
    SELECT series, segment_id, CAST(bytes AS BIGINT) AS bytes FROM r, x WHERE gone < excess"""
)
def quota_victims(spark, d):
    points = blocks_of(spark, d)
    s = catalog.segment_bounds(points).withColumn("bytes", X.raw_bytes(F.col("point_count")))
    return catalog.quota_victims(s, "bytes", F.expr("sum(bytes) div 2")).select("series", "segment_id", "bytes")


@query(f"SELECT series, segment_id, CASE WHEN segment_id = max(segment_id) OVER (PARTITION BY series) THEN 'active' WHEN max_timestamp < {CUTOFF} THEN 'old' ELSE 'sealed' END AS status FROM {SEGMENTS}")
def segment_status(spark, d):
    return catalog.segment_status(catalog.segment_bounds(blocks_of(spark, d)), CUTOFF).select("series", "segment_id", "status")


@query("SELECT count(*) AS series_count, CAST(sum(n) AS BIGINT) AS total_points, CAST(sum(n) * 16 AS BIGINT) AS raw_size_bytes, CAST(sum(n * 10) AS BIGINT) AS compressed_size_bytes, sum(n) * 16 / sum(n * 10) AS compression_ratio, sum(n * 10) / sum(n) AS bytes_per_point FROM (SELECT series, count(*) AS n FROM " + EVENTS + " GROUP BY 1)")
def storage_totals(spark, d):
    """At ten bytes a stored point."""
    c = catalog.list_series(blocks_of(spark, d)).withColumn("compressed_size_bytes", F.col("total_points") * 10)
    return catalog.storage_totals(c)


@query(f"SELECT series, count(*) % {BLOCK} AS buffered, least(100.0, (count(*) % {BLOCK}) * 100.0 / {BLOCK}) AS fill_percent FROM {EVENTS} GROUP BY 1")
def buffer_fill(spark, d):
    n = F.count(F.lit(1)) % BLOCK
    return ev(spark, d).select().groupBy("series").agg(n.alias("buffered")).withColumn("fill_percent", X.percent(F.col("buffered").cast("double"), F.lit(float(BLOCK))))


# roll-ups

WINDOWS = "(" + windowed_sql(EVENTS, START, END, W6, by="series") + ")"


@query(f"SELECT series, count(*) AS window_count, CAST(sum(count) AS BIGINT) AS source_points, sum(count) / count(*) AS downsample_ratio, min(min) AS global_min, max(max) AS global_max, arg_min(avg, window_start) AS first_avg, arg_max(avg, window_start) AS last_avg, min(window_start) AS first_window, max(window_start) AS last_window FROM {WINDOWS} GROUP BY 1")
def window_rollup(spark, d):
    w = windowed(ev(spark, d), START, END, W6, by=["series"])
    return rollup.window_rollup(w, ["series"]).drop("avg_of_avgs", "weighted_avg")


@query(f"SELECT floor(avg(avg) * 1000 + 0.5) / 1000 AS avg_of_avgs, floor(sum(avg * count) / sum(count) * 1000 + 0.5) / 1000 AS weighted_avg FROM {WINDOWS}")
def window_rollup_means(spark, d):
    r = rollup.window_rollup(windowed(ev(spark, d), START, END, W6, by=["series"]))
    return r.select(*[(F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) for c in ("avg_of_avgs", "weighted_avg")])


@query(f"SELECT series, arg_min(avg, window_start) AS first_avg, arg_max(avg, window_start) AS last_avg FROM {WINDOWS} GROUP BY 1")
def window_first_last(spark, d):
    w = windowed(ev(spark, d), START, END, W6, by=["series"])
    return rollup.window_rollup(w, ["series"]).select("series", "first_avg", "last_avg")


@query(f"SELECT floor(sum(a * n) / sum(n) * 1000 + 0.5) / 1000 AS weighted_avg, CAST(sum(n) AS BIGINT) AS points FROM (SELECT {AVG} AS a, count(*) AS n FROM {ORDERS} WHERE t BETWEEN {LI_START} AND {LI_END} GROUP BY series)")
def weighted_avg_multi(spark, d):
    g = reads.aggregate(od(spark, d), LI_START, LI_END, ["avg", "count"], by=["series"], exact_scale=EXACT)
    return rollup.weighted_average(g).select((F.floor(F.col("weighted_avg") * 1000 + 0.5) / 1000).alias("weighted_avg"), "points")


@query(f"SELECT min(a) AS min, max(b) AS max FROM (SELECT min(v) AS a, max(v) AS b FROM {LINEITEM} WHERE t BETWEEN {LI_START} AND {LI_END} GROUP BY series)")
def min_max_multi(spark, d):
    g = reads.aggregate(li(spark, d), LI_START, LI_END, ["min", "max"], by=["series"])
    return g.agg(F.min("min").alias("min"), F.max("max").alias("max"))


@query(f"WITH m AS (SELECT series, max(t) AS z FROM {EVENTS} GROUP BY 1) SELECT series, {AVG} AS avg, count(*) AS points_read FROM {EVENTS} JOIN m USING (series) WHERE t >= z - {HOUR * 24} GROUP BY 1")
def last_day_avg(spark, d):
    rows = reads.recent(ev(spark, d), 24 * HOUR)
    return rows.groupBy("series").agg(reads.average(F.col("value"), EXACT).alias("avg"), F.count(F.lit(1)).alias("points_read"))


@query(f"SELECT {AVG} AS avg FROM {EVENTS} WHERE t >= (SELECT max(t) FROM {EVENTS}) - {HOUR}")
def last_hour_avg(spark, d):
    rows = ev(spark, d).select().withColumn("all", F.lit(1))
    return _recent(rows, HOUR).agg(reads.average(F.col("value"), EXACT).alias("avg"))


@query(f"SELECT count(*) AS count FROM {EVENTS} WHERE t >= (SELECT max(t) FROM {EVENTS}) - {10 * 60_000_000}")
def last_10min_count(spark, d):
    return _recent(ev(spark, d).select(), 10 * 60_000_000).agg(F.count(F.lit(1)).alias("count"))


def _recent(rows: DataFrame, length: int) -> DataFrame:
    last = rows.agg(F.max("timestamp").alias("last"))
    return rows.crossJoin(F.broadcast(last)).filter(F.col("timestamp") >= F.col("last") - length)  # one row


@query(f"SELECT seq, t - lag(t) OVER (PARTITION BY series ORDER BY seq) AS delta FROM {EVENTS}")
def ts_delta(spark, d):
    return rollup.deltas(ev(spark, d).select()).select("seq", "delta")


@query(f"SELECT seq, x - lag(x) OVER (PARTITION BY series ORDER BY seq) AS delta_of_delta FROM (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY seq) AS x FROM {EVENTS})")
def ts_delta_of_delta(spark, d):
    return rollup.deltas(ev(spark, d).select()).select("seq", "delta_of_delta")


@query(f"SELECT seq, sum(f) OVER (PARTITION BY series ORDER BY seq) AS run FROM (SELECT *, CASE WHEN v < lag(v) OVER (PARTITION BY series ORDER BY seq) THEN 1 ELSE 0 END AS f FROM {EVENTS})".replace("sum(f) OVER (PARTITION BY series ORDER BY seq)", "CAST(sum(f) OVER (PARTITION BY series ORDER BY seq) AS BIGINT)"))
def counter_resets(spark, d):
    return rollup.resets(ev(spark, d).select()).select("seq", "run")


@query(f"SELECT seq, CASE WHEN v = lag(v) OVER (PARTITION BY series ORDER BY seq) THEN false ELSE true END AS changed FROM {EVENTS}")
def value_changes(spark, d):
    return rollup.value_changes(ev(spark, d).select()).select("seq", "changed")


@query("SELECT event_type AS series, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1")
def time_in_ms(spark, d):
    rows = Points(table(spark, d, "events"), "event_type", "ts", "value", unit="ms").select()
    return rows.groupBy("series").agg(F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


# sorts and limits


@query(f"SELECT series, t AS timestamp, v AS value FROM {EVENTS} ORDER BY t LIMIT 10")
def first_n_points(spark, d):
    return reads.first_points(ev(spark, d), 10).drop("seq")


@query(f"SELECT series, t AS timestamp, v AS value, place FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t DESC, v DESC) AS place FROM {EVENTS}) WHERE place <= 48")
def last_48_points(spark, d):
    return rollup.last_points(ev(spark, d).select(), 48).select("series", "timestamp", "value", F.col("place").cast("long").alias("place"))


@query(f"SELECT series, arg_max(t, (v, -t)) AS timestamp, max(v) AS value FROM {EVENTS} GROUP BY 1")
def top_value_per_series(spark, d):
    return rollup.top_value(ev(spark, d).select())


@query(f"SELECT t AS timestamp, series, v AS value FROM {EVENTS} ORDER BY t DESC LIMIT 40")
def latest_events(spark, d):
    return ev(spark, d).select().orderBy(F.desc("timestamp")).limit(40).drop("seq")


@query(f"SELECT series, segment_id, row_number() OVER (ORDER BY max_timestamp, series, segment_id) AS place FROM {SEGMENTS}")
def segments_oldest_first(spark, d):
    w = Window.orderBy("max_timestamp", "series", "segment_id")
    return catalog.segment_bounds(blocks_of(spark, d)).select("series", "segment_id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT DISTINCT ON (series) series, t AS timestamp FROM " + EVENTS + " ORDER BY series, v DESC, t")
def preferred_row(spark, d):
    return rollup.preferred(ev(spark, d).select(), ["series"], [F.desc("value"), F.asc("timestamp")]).select("series", "timestamp")


# tables of runs: systems, datasets and their measures stand in for benchmark results

RUNS = "(SELECT n_name AS dataset, c_mktsegment AS system, CAST(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS DOUBLE) / count(*) AS score, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
SYSTEMS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def runs(spark, d) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("system")).agg(reads.average(F.col("c_acctbal"), EXACT).alias("score"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT dataset, " + ", ".join(f"avg(score) FILTER (system = '{s}') AS {s}" for s in SYSTEMS) + f" FROM {RUNS} GROUP BY 1")
def pivot_avg_by_type(spark, d):
    return rollup.pivot_mean(runs(spark, d), "dataset", "system", SYSTEMS, "score")


@query(f"SELECT a.dataset, a.system, a.score / b.score AS relative, 1 - a.score / b.score AS saving FROM {RUNS} a LEFT JOIN {RUNS} b ON a.dataset = b.dataset AND b.system = 'BUILDING'")
def relative_to_baseline(spark, d):
    return rollup.relative_to(runs(spark, d), "dataset", "system", "BUILDING", "score").select("dataset", "system", "relative", "saving")


@query(f"SELECT dataset, string_agg(DISTINCT system, ', ' ORDER BY system) AS names FROM {RUNS} GROUP BY 1")
def systems_per_group(spark, d):
    return rollup.names_by_group(runs(spark, d), "dataset", "system")


@query(f"SELECT count(*) AS n, floor(avg(a.score / b.score) * 1000 + 0.5) / 1000 AS mean_ratio FROM {RUNS} a JOIN {RUNS} b USING (dataset) WHERE a.system = 'MACHINERY' AND b.system = 'BUILDING'")
def mean_of_ratios(spark, d):
    r = runs(spark, d)
    out = rollup.mean_ratio(r.filter("system = 'MACHINERY'"), r.filter("system = 'BUILDING'"), "dataset", "score")
    return out.select("n", (F.floor(F.col("mean_ratio") * 1000 + 0.5) / 1000).alias("mean_ratio"))


@query(f"SELECT dataset, arg_max(system, score) AS best, arg_min(system, score) AS worst FROM {RUNS} GROUP BY 1")
def best_and_worst(spark, d):
    return runs(spark, d).groupBy("dataset").agg(F.max_by("system", "score").alias("best"), F.min_by("system", "score").alias("worst"))


@query(f"SELECT dataset, system, n, CASE WHEN n > 2 THEN n / (n - 2.0) ELSE 0 END AS n_per_sec FROM {RUNS}")
def throughput_guarded(spark, d):
    return rollup.throughput(runs(spark, d).withColumn("seconds", F.greatest(F.lit(0), F.col("n") - 2)), "n", "seconds").select("dataset", "system", "n", "n_per_sec")


@query("SELECT n_name AS dataset, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey")
def metadata_lookup(spark, d):
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    return table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("title"))


# set operations


@query(f"SELECT series, count(*) AS n, {SUM} AS total FROM (SELECT * FROM {NUMBERED} WHERE b < 2 UNION ALL SELECT * FROM {NUMBERED} WHERE b >= 2) GROUP BY 1")
def union_buffer_blocks(spark, d):
    """Stored blocks and the buffer read as one."""
    p = blocks_of(spark, d)
    both = p.filter("block_id < 2").unionByName(p.filter("block_id >= 2"))
    return both.groupBy("series").agg(F.count(F.lit(1)).alias("n"), reads.total(F.col("value"), EXACT).alias("total"))


@query(f"SELECT name FROM (VALUES ('click'), ('purchase'), ('wind.speed'), ('air.temperature')) v(name) WHERE name NOT IN (SELECT series FROM {EVENTS})")
def missing_series_anti(spark, d):
    wanted = spark.createDataFrame([("click",), ("purchase",), ("wind.speed",), ("air.temperature",)], "name string")
    return rollup.missing(wanted, ev(spark, d).select().select(F.col("series").alias("name")).distinct(), "name")


@query(f"SELECT DISTINCT CAST(g AS INTEGER) AS segment_id FROM {NUMBERED}")
def segment_ids(spark, d):
    return blocks_of(spark, d).select("segment_id").distinct()


# scalar functions


@query(f"SELECT seq, CASE WHEN v > 75 THEN 'high' WHEN v > 35 THEN 'elevated' ELSE 'normal' END AS label FROM {EVENTS}")
def alert_labels(spark, d):
    return ev(spark, d).select().select("seq", X.label(F.col("value"), X.ALERTS["pm25.concentration"]).alias("label"))


NAMES = ["motor.temperature", "", "a/b", "back\\slash", ".", "..", "x" * 255, "x" * 256, "é" * 128, "007", "with space", "wind-speed_1"]
VALUES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(NAMES))


def names(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES)), "k int, name string")


@query(f"SELECT k, strlen(name) BETWEEN 1 AND 255 AND NOT regexp_matches(name, '[/\\\\]') AND name NOT IN ('.', '..') AS valid FROM (VALUES {VALUES}) v(k, name)")
def valid_series_name(spark, d):
    return names(spark).select("k", X.valid_name_column(F.col("name")).alias("valid"))


@query(f"SELECT k, CASE WHEN name = '' THEN 'series' ELSE regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') END || '.csv' AS file, regexp_full_match(name || '.csv', '[A-Za-z0-9_-]+\\.csv') AS safe FROM (VALUES {VALUES}) v(k, name)")
def sanitize_filename(spark, d):
    return names(spark).select("k", X.file_name(F.col("name")).alias("file"), X.safe_csv_name(F.concat("name", F.lit(".csv"))).alias("safe"))


@query("SELECT CAST(k AS INTEGER) AS k, printf('segment_%06d.tse', k) AS file, CAST(k AS INTEGER) AS parsed FROM (SELECT unnest([1, 42, 999999, 1000000, 12345678]) AS k)")
def segment_filename(spark, d):
    rows = spark.createDataFrame([(k,) for k in (1, 42, 999_999, 1_000_000, 12_345_678)], "k int").withColumn("file", X.segment_file(F.col("k")))
    return rows.withColumn("parsed", X.segment_id(F.col("file")))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT CAST(i AS INTEGER) AS i, TRY_CAST(s AS DOUBLE) AS v FROM (VALUES (1, '1.5'), (2, 'n/a'), (3, ''), (4, '-2e3')) t(i, s)")
def coerce_numeric(spark, d):
    rows = spark.createDataFrame([(1, "1.5"), (2, "n/a"), (3, ""), (4, "-2e3")], "i int, s string")
    return rows.select("i", X.number_or_null(F.col("s")).alias("v"))


@query(f"SELECT seq, (v - a) / greatest(1, b - a) AS scaled FROM (SELECT *, min(v) OVER (PARTITION BY series) AS a, max(v) OVER (PARTITION BY series) AS b FROM {EVENTS})")
def sparkline_scale(spark, d):
    rows = ev(spark, d).select()
    extent = rows.groupBy("series").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return rows.join(extent, "series").select("seq", X.scaled(F.col("value"), F.col("a"), F.col("b")).alias("scaled"))


@query(f"SELECT seq, strftime(make_timestamp(t), '%H:%M:%S') AS clock FROM {EVENTS}")
def event_clock(spark, d):
    return ev(spark, d).select().select("seq", X.clock(F.col("timestamp")).alias("clock"))


@query(f"SELECT event_type, CASE WHEN contains(event_type, 'click') THEN 'input' WHEN regexp_matches(event_type, 'purchase|refund') THEN 'money' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def message_classifier(spark, d):
    c = F.col("event_type")
    kind = F.when(F.contains(c, F.lit("click")), "input").when(c.rlike("purchase|refund"), "money").otherwise("other")
    return table(spark, d, "events").groupBy("event_type", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


# generators and streams


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(timestamp) AS last, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT 1710000000000 + 1000 * i + 37 * (i % 11) * (i % 11) AS timestamp, 50 + (i // 1000) % 20 AS value FROM (SELECT unnest(range(20000)) AS i))")
def generator_step_irregular(spark, d):
    a = generators.generate(spark, "irregular", 20_000).select("seq", "timestamp")
    b = generators.generate(spark, "step", 20_000).select("seq", "value")
    return a.join(b, "seq").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"), reads.total(F.col("value"), EXACT).alias("total"))


@query("SELECT series, CAST(500 AS BIGINT) AS n FROM (VALUES ('air.temperature'), ('air.humidity'), ('air.pressure'), ('wind.speed'), ('pm25.concentration'), ('battery.voltage')) v(series)")
def generator_station(spark, d):
    return generators.station(spark, 500).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


@query(windowed_sql(EVENTS, START, END, W6, by="series").replace(f"{AVG} AS avg", "floor(avg(v) * 1000 + 0.5) / 1000 AS avg"))
def stream_window_complete(spark, d):
    """The windows of all series through the streaming engine, complete mode."""
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    points = events(raw).select()
    out = ingest.run_to_memory(ingest.windows(points, START, END, W6), "tidemark_stream_windows")
    return out.withColumn("avg", F.floor(F.col("avg") * 1000 + 0.5) / 1000)

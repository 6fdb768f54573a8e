"""Streams, files, generators, policies and the registered queries."""

import importlib
import struct
import sys

import duckdb
import pytest

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import catalog, rollup
from tidemark.plans import catalogue
from tidemark.schema import POINTS
from tidemark.sources import files, generators
from tidemark.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df):
    number = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([number(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).to_numpy().tolist())


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_oracle(spark, data, duck, name):
    found = catalogue.queries()[name](spark, data).toPandas()
    expected = duck.execute(catalogue.oracle_sql()[name]).df()
    assert set(found.columns) == set(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_module(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_needs_the_corpus_operators():
    """The engine's modules import nothing from the subpackage."""
    own = [m for n, m in sys.modules.items() if n.startswith("tidemark") and not n.startswith("tidemark.llm")]
    for m in own:
        assert not any(getattr(v, "__module__", "").startswith("tidemark.llm") for v in vars(m).values() if callable(v))


def test_streaming_ingest_restarts_without_loss_or_repeats(spark, tmp_path):
    source, root, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def feed(lo, hi):
        spark.range(lo, hi).selectExpr("concat('s', id % 2) AS series", "id AS timestamp", "cast(id AS double) AS value").write.mode("append").parquet(source)

    feed(0, 100)
    for lo in (100, 200):
        ingest.ingest(ingest.source(spark, source), root, check).awaitTermination()
        feed(lo, lo + 100)
    ingest.ingest(ingest.source(spark, source), root, check).awaitTermination()
    got = ingest.ingested(spark, root)
    assert got.columns == POINTS.fieldNames()
    assert sorted(r.timestamp for r in got.collect()) == list(range(300))


def test_streaming_windows_sliding_sessions_and_spikes(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(100).selectExpr("'s' AS series", "id * 1000000 AS timestamp", "cast(id % 50 AS double) AS value").coalesce(1).write.parquet(path)
    w = ingest.run_to_memory(ingest.windows(ingest.source(spark, path), 0, 95_000_000, 10_000_000), "w1").orderBy("window_start").collect()
    assert len(w) == 10 and tuple(w[-1])[1:4] == (90_000_000, 95_000_000, 5)
    s = ingest.run_to_memory(ingest.sliding(ingest.event_time(ingest.source(spark, path)), "20 seconds", "10 seconds"), "w2")
    assert s.agg({"count": "sum"}).first()[0] == 200
    n = ingest.run_to_memory(ingest.sessions(ingest.event_time(ingest.source(spark, path)), "5 seconds"), "w3")
    assert [r["count"] for r in n.collect()] == [100]
    late = ingest.event_time(ingest.source(spark, path), "10 seconds")
    assert ingest.run_to_memory(ingest.sliding(late, "10 seconds", "10 seconds"), "w4", "append").count() < 10
    up = ingest.run_to_memory(ingest.spikes(ingest.source(spark, path), 48.5, 3), "w5", "append").filter("raised").collect()
    assert sorted(r.timestamp // 1_000_000 for r in up) == [49, 50, 51, 99]


def test_files(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("timestamp,value\n1,2.5\nbad,line\n3,4e2\n")
    assert [tuple(r) for r in files.read_csv(spark, str(csv), "s").collect()] == [("s", 1, 2.5), ("s", 3, 400.0)]
    raw = tmp_path / "p.bin"
    raw.write_bytes(b"".join(struct.pack("<qd", k, k / 2) for k in range(5)) + b"torn")
    assert [tuple(r) for r in files.read_binary(spark, str(raw), "s").orderBy("timestamp").collect()] == [("s", k, k / 2) for k in range(5)]
    assert files.read_results(spark, str(tmp_path / "none*.csv"), "a int").count() == 0
    lines = spark.createDataFrame([('{"command": "window", "window_size": 5}',), ("{}",), ("not json",)], "value string")
    assert [tuple(r) for r in files.commands(lines).collect()] == [("window", None, 5, 1)]
    files.write_results(spark.range(3), str(tmp_path / "out"), order=["id"])
    assert files.read_results(spark, str(tmp_path / "out"), "id bigint").count() == 3


def test_generators(spark):
    g = generators.generate(spark, "step", 2500).orderBy("timestamp").collect()
    assert g[0].value == 50 and g[1000].value == 51 and g[1].timestamp - g[0].timestamp == 1000
    assert generators.generate(spark, "noisy", 100, seed=3).collect() == generators.generate(spark, "noisy", 100, seed=3).collect()
    assert generators.station(spark, 10).count() == 60


def test_quota_policy_matches_a_plain_loop(spark):
    sizes = [("a", 1, 10, 40), ("a", 2, 20, 40), ("a", 3, 30, 40), ("b", 1, 5, 30), ("b", 2, 25, 30)]
    df = spark.createDataFrame(sizes, "series string, segment_id int, max_timestamp bigint, bytes bigint")
    for quota in (10**6, 180, 150, 149, 100, 0):
        left, want = 180, []
        for s, g, _, b in sorted((x for x in sizes if (x[0], x[1]) not in (("a", 3), ("b", 2))), key=lambda x: (x[2], x[0], x[1])):
            if left > quota:
                left, want = left - b, [*want, (s, g)]
        assert sorted((r.series, r.segment_id) for r in catalog.quota_victims(df, "bytes", quota).collect()) == sorted(want)


def test_names_and_numbers(spark):
    assert X.valid_name("a" * 255) and not X.valid_name("é" * 128) and not X.valid_name("..")
    assert X.file_name_of("é/x y") == "___x_y.csv" and X.file_name_of("") == "series.csv"
    assert X.format_17g(0.1) == "0.10000000000000001" and X.format_17g(100.0) == "100"
    row = spark.range(1).select(X.human_bytes(X.F.lit(1536)).alias("a"), X.ratio(X.F.lit(1.0), X.F.lit(0.0)).alias("b"), X.segment_id(X.F.lit("segment_0001.tse")).alias("c"))
    assert tuple(row.first()) == ("1.5 KB", 0.0, None)


def test_places_do_not_depend_on_buckets(spark):
    df = spark.range(500).selectExpr("concat('s', id % 3) AS series", "(id * 7919) % 500 AS seq", "id AS timestamp", "0D AS value")
    one, many = (catalog.place_in_series(df, "seq", n).select("series", "seq", "place").orderBy("series", "seq").collect() for n in (10**6, 7))
    assert one == many and [r.place for r in one[:4]] == [0, 1, 2, 3]


def test_windows_over_buckets_equal_those_over_whole_series(spark):
    """Steps, changes and runs do not depend on how the order is cut, skewed orders and tiny buckets included."""
    import random

    r = random.Random(4)
    rows = [(s, r.choice([k, 10**12 + k]), k * 3 + s, float(r.randrange(4))) for s in range(3) for k in range(60 if s else 1)]
    df = spark.createDataFrame([(f"s{s}", q, t, v) for s, q, t, v in rows], "series string, seq long, timestamp long, value double")
    for step in (rollup.deltas, rollup.value_changes, rollup.resets):
        one, many = (sorted(map(tuple, step(df, rows_per_bucket=n).collect()), key=lambda x: x[:2]) for n in (10**6, 5))
        assert one == many, step.__name__
    plans = [step(df, rows_per_bucket=5)._jdf.queryExecution().optimizedPlan().toString() for step in (rollup.deltas, rollup.resets)]
    assert all("__b" in p for p in plans)


def test_bounds_of_dates_and_coarse_units_are_exact_and_pushed(spark, tmp_path):
    import datetime

    from tidemark.sources.points import Points

    day = 86_400_000_000
    df = spark.createDataFrame([("a", datetime.date(1970, 1, k + 1), float(k)) for k in range(9)], "series string, timestamp date, value double")
    got = lambda low, high, **o: sorted(r.value for r in Points(df).select(low, high, **o).collect())
    assert got(2 * day, 4 * day) == [2.0, 3.0, 4.0] and got(2 * day + 1, 4 * day - 1) == [3.0]
    assert got(2 * day, 4 * day, closed=False) == [2.0, 3.0]
    spark.sql("SELECT 'a' AS series, timestamp_micros(id * 700) AS timestamp, double(id) AS value FROM range(20)").write.parquet(f"{tmp_path}/t")
    points = Points(spark.read.parquet(f"{tmp_path}/t"), unit="ms")
    some = points.select(1, 6)
    assert sorted(r.value for r in some.collect()) == [float(k) for k in range(20) if 1 <= k * 700 // 1000 <= 6]
    assert "LessThan(timestamp" in some._jdf.queryExecution().executedPlan().toString()


def test_exact_sums_pass_nan_and_large_numbers_on(spark):
    from tidemark.operators.reads import average, total

    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", float("nan")), ("b", 1.0), ("c", 1e20), ("c", 1.0)], "k string, v double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(total(F.col("v"), 2).alias("s"), average(F.col("v"), 2).alias("m")).collect()}
    assert got["a"] == (0.3, 0.15) and got["b"][0] != got["b"][0] and got["c"][0] == 1e20 + 1.0


def test_largest_value_at_the_earliest_of_all_times(spark):
    df = spark.createDataFrame([("a", -(2**63), 5.0), ("a", 3, 5.0), ("a", 1, 4.0)], "series string, timestamp long, value double")
    assert [tuple(r) for r in rollup.top_value(df).collect()] == [("a", 5.0, -(2**63))]

"""Range reads, aggregates and windows: golden cases, a plain Python oracle, pushed filters, layouts."""

import math
import random

import pytest

from tidemark.operators import reads
from tidemark.schema import Aggregate, Durability, Status, TidemarkError
from tidemark.sources.points import Points, events


def points(spark, rows, series="s"):
    return Points(spark.createDataFrame([(series, t, float(v)) for t, v in rows], "series string, timestamp bigint, value double"))


def windows(spark, rows, *args):
    return [tuple(r) for r in reads.aggregate_windowed(points(spark, rows), *args).orderBy("window_start").collect()]


def test_windows_golden(spark):
    assert windows(spark, [(i, i) for i in range(10)], 0, 10, 5) == [(0, 5, 5, 0.0, 4.0, 2.0), (5, 10, 5, 5.0, 9.0, 7.0)]
    assert windows(spark, [(t, t) for t in (0, 99, 100, 199, 200)], 0, 300, 100) == [(0, 100, 2, 0.0, 99.0, 49.5), (100, 200, 2, 100.0, 199.0, 149.5), (200, 300, 1, 200.0, 200.0, 200.0)]
    assert windows(spark, [(0, 10), (250, 20), (450, 30)], 0, 500, 100) == [(0, 100, 1, 10.0, 10.0, 10.0), (200, 300, 1, 20.0, 20.0, 20.0), (400, 500, 1, 30.0, 30.0, 30.0)]
    assert windows(spark, [(10, 1)], 100, 200, 10) == windows(spark, [(10, 1)], 10, 10, 10) == []


def test_window_clipped_negative_duplicates_and_extremes(spark):
    assert windows(spark, [(i, i) for i in range(10)], 0, 10, 4)[-1] == (8, 10, 2, 8.0, 9.0, 8.5)
    assert windows(spark, [(-7, 1), (-7, 3), (-1, 5)], -7, 0, 4) == [(-7, -3, 2, 1.0, 3.0, 2.0), (-3, 0, 1, 5.0, 5.0, 5.0)]
    top = 2**63 - 1
    assert windows(spark, [(top - 1, 2)], top - 10, top, 7) == [(top - 3, top, 1, 2.0, 2.0, 2.0)]
    assert windows(spark, [(-(2**63), 2)], -(2**63), -(2**63) + 10, 4) == [(-(2**63), -(2**63) + 4, 1, 2.0, 2.0, 2.0)]


@pytest.mark.parametrize("args", [(0, 10, 0), (0, 10, -1), (10, 0, 5), (0, 1_000_001, 1), (-1, 2**63 - 1, 2**62), (0, 2**64, 5), (0, 10, True)])
def test_window_errors(spark, args):
    with pytest.raises(TidemarkError) as e:
        windows(spark, [(1, 1)], *args)
    assert e.value.code == Status.INVALID_ARGUMENT


def test_aggregates_golden(spark):
    p = points(spark, [(1000 + 10 * i, 10.0 if i == 0 else i) for i in range(100)])
    r = reads.aggregate(p, 1010, 1040, ["min", "MAX", 2, Aggregate.AVG, " count "]).first()
    assert tuple(r) == (1.0, 4.0, 10.0, 2.5, 4)
    assert reads.read_range(p, 1000, 1030).count() == 4 and reads.read_range(p, 5000, 6000).count() == 0
    assert tuple(reads.aggregate(p, 1, 2, ["count", "avg"]).first()) == (0, None)
    for bad in ("median", 9, None):
        with pytest.raises(TidemarkError):
            reads.aggregate(p, 0, 1, [bad])
    with pytest.raises(TidemarkError):
        reads.read_range(p, 2, 1)
    assert Durability.of("strict") is Durability.STRICT


def test_nan_infinity_and_negative_zero(spark):
    nan, inf = math.nan, math.inf
    r = reads.aggregate(points(spark, [(1, nan), (2, 3.0), (3, -inf), (4, inf)]), 0, 9, ["min", "max", "count"]).first()
    assert tuple(r) == (-inf, inf, 4)
    r = reads.aggregate(points(spark, [(1, nan), (2, 3.0), (3, nan)]), 0, 9, ["min", "max", "sum"]).first()
    assert r[0] == r[1] == 3.0 and math.isnan(r[2])
    assert math.isnan(reads.aggregate(points(spark, [(1, nan)]), 0, 9, ["max"]).first()[0])
    assert reads.aggregate(points(spark, [(1, -0.0)]), 0, 9, ["min"]).first()[0] == 0.0


def test_random_points_against_plain_python_and_any_layout(spark):
    r = random.Random(5)
    rows = [(r.randrange(-5000, 5000), r.randrange(-10000, 10000) / 100) for _ in range(3000)]
    for _ in range(4):
        start, size = r.randrange(-5200, 0), r.randrange(1, 900)
        end = start + r.randrange(0, 9000)
        expected = {}
        for t, v in rows:
            if start <= t < end:
                expected.setdefault((t - start) // size, []).append(v)
        want = [(start + k * size, min(start + (k + 1) * size, end), len(v), min(v), max(v), pytest.approx(sum(v) / len(v))) for k, v in sorted(expected.items())]
        assert windows(spark, rows, start, end, size) == want
    p = points(spark, rows)
    wide = Points(p.table.repartition(7))
    a, b = (reads.aggregate_windowed(x, -5000, 5000, 333, exact_scale=2).orderBy("window_start").collect() for x in (p, wide))
    assert a == b


def test_bounds_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/events.parquet")
    out = reads.aggregate_windowed(events(df), 1704067200000000, 1704153600000000, 3_600_000_000, series="click")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_units_and_recent(spark, data):
    df = spark.read.parquet(f"{data}/events.parquet")
    ms = Points(df, "event_type", "ts", "value", unit="ms")
    us = Points(df, "event_type", "ts", "value")
    lo, hi = 1704067200000, 1704153600000
    assert ms.select(lo, hi, closed=False).count() == us.select(lo * 1000, hi * 1000, closed=False).count()
    last = us.select().agg({"timestamp": "max"}).first()[0]
    assert reads.recent(us, 0).filter(f"timestamp = {last}").count() == 1
    assert us.select(-(2**63), 2**63 - 1).count() == df.count()
    with pytest.raises(TidemarkError):
        Points(df, unit="h")

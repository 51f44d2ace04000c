"""Scalar functions and folds on small values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trailmill.functions import geo


def test_offset_system_round_trip(spark):
    d = spark.createDataFrame([(30.59, 114.30), (39.9, 116.4), (48.85, 2.35)], "lat double, lng double")
    there = d.select("lat", "lng", geo.wgs_to_gcj("lat", "lng").alias("g"))
    got = there.collect()
    assert all(math.hypot(r["lat"] - r["g"]["lat"], r["lng"] - r["g"]["lng"]) < 0.02 for r in got)
    assert got[2]["g"]["lat"] == pytest.approx(48.85) and got[2]["g"]["lng"] == pytest.approx(2.35)  # outside it is the identity


def test_null_positions_stay_null(spark):
    d = spark.createDataFrame([(None, 114.30)], "lat double, lng double")
    assert d.select(F.isnull(geo.wgs_to_gcj("lat", "lng")["lat"]).alias("x")).first()["x"]


def test_span_at_a_limit_of_zoom(spark):
    """A span of 0.01 is no smaller than 0.01, though the difference of its ends is."""
    from trailmill.operators import trips

    d = spark.createDataFrame([(1, 30.58641, 114.2974), (1, 30.59641, 114.30102), (2, 30.0, 114.0), (2, 30.0099, 114.0)], "trip_id long, lat double, lng double")
    assert 30.59641 - 30.58641 < 0.01
    assert {r["trip_id"]: r["zoom"] for r in trips.boxes(d).collect()} == {1: 14, 2: 15}


def test_mean_positions_on_lines(spark):
    """The windows give what the array functions give: lines nearest at their start, within and at their end, steps of no length, a trip that stands; one point is no line."""
    from trailmill.operators import trips

    walks = {
        1: [(30.0, 114.0), (30.001, 114.0), (30.001, 114.001), (30.0, 114.001), (30.0, 114.0)],
        2: [(30.0, 114.0), (30.0, 114.0), (30.0005, 114.0), (30.0005, 114.0), (30.0, 114.001), (30.0003, 114.0004)],
        3: [(30.0, 114.0)] * 3,
        4: [(30.0, 114.0)],
        5: [(30.0004, 114.0004), (30.0, 114.0), (30.001, 114.0), (30.001, 114.001), (30.0, 114.001)],
    }
    rows = [(trip * 100 + i, trip, 1000 * (i // 2), *at) for trip, line in walks.items() for i, at in enumerate(line)]
    p = spark.createDataFrame(rows, "id long, trip_id long, ts long, lat double, lng double").orderBy(F.desc("id"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "lat", "lng"))), lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng")))
    g = p.groupBy("trip_id").agg(line.alias("p"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).filter(F.size("p") > 1).withColumn("q", geo.polyline_projection("lat", "lng", "p"))
    for start in (0.0, 5.0, 120.0, 1e6):
        want = g.select("trip_id", "q.distance", "q.offset", F.size(geo.slice_polyline("p", F.lit(start), F.col("q.offset"))).alias("cut")).collect()
        got = {r["trip_id"]: r for r in trips.nearest_on_line(p, start).collect()}
        assert sorted(got) == [1, 2, 3, 5]
        for r in want:
            assert tuple(got[r["trip_id"]])[1:] == pytest.approx(tuple(r)[1:], abs=1e-6)


def test_long_lines_are_no_single_values(spark):
    """A straight line of 20 000 points: no array holds it, and the points between are all counted."""
    from trailmill.queries import scalars

    n = 20_000
    i = F.col("id")
    p = spark.range(n).select("id", F.lit(1).cast("long").alias("trip_id"), (i * 1000).alias("ts"), (30.0 + i * 0.0001).alias("lat"), F.lit(114.0).alias("lng"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scalars, "derived", lambda *_: p)
        d = scalars.polyline_projection(spark, "")
    assert "collect_list" not in d._jdf.queryExecution().optimizedPlan().toString()
    r = d.first()
    assert (r["distance"], r["cut"]) == (0.0, n // 2 + 1) and r["offset"] == pytest.approx((n - 1) / 2 * 11.132, abs=10_000 * 0.02)

"""Points nearest to where two edges meet: which of the two comes fourth is in the last bits of their probabilities."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from trailmill.operators import matching
from trailmill.queries import roads
from trailmill.queries.sqltext import TP

COLUMNS = "id long, user_id long, trip_id long, ts long, lat double, lng double, accuracy_m double, speed_mps double, heading_deg double, source string, raw_coord_type string"
#: Of a track of six million points: one of a step of each trip, and the points before and after it.
TRIPS = {
    1: [(30.58304, 114.31379, None), (30.583, 114.314, None)],
    2: [(30.58514, 114.3018, None), (30.58501, 114.30199999999999, None)],
    3: [(30.59109, 114.29536, None), (30.59101, 114.29599999999999, None), (30.59245, 114.2948, None)],
    4: [(30.58305, 114.28990999999999, None), (30.58301, 114.28999999999999, -1.0), (30.58281, 114.29005, None)],
}


def test_close_calls_equal_sql(spark, monkeypatch):
    rows = [(trip * 10 + i, 1, trip, i * 10_000, *at[:2], 5.0, None, at[2], "x", "WGS84") for trip, points in TRIPS.items() for i, at in enumerate(points)]
    monkeypatch.setattr(roads, "_points", lambda *_: spark.createDataFrame(rows, COLUMNS))
    con = duckdb.connect()
    con.execute(f"create table track ({COLUMNS.replace('long', 'bigint').replace('string', 'varchar')})")
    con.executemany(f"insert into track values ({', '.join('?' * 11)})", rows)
    for name in ("candidates_topk", "candidate_prob_norm"):
        query, sql = roads.QUERIES[name]
        want = con.sql(sql.replace(TP, "track")).fetchall()
        assert len(want) > 20
        assert sorted(map(tuple, query(spark, "").collect())) == sorted(map(tuple, want))


def test_close_calls_are_few_and_whole(spark):
    """Only points with a close call among the first edges are told, and no point loses or doubles an edge."""
    rows = [(1, 0.5), (1, 0.5 * (1 - 1e-14)), (1, 0.1), (2, 0.5), (2, 0.4), (2, 0.1), (2, 0.1), (3, 0.5)]
    near = spark.createDataFrame(rows, "id long, raw_prob double")
    told = lambda most: sorted(r["id"] for r in matching._close_calls(near, most).collect())
    assert told(2) == [1] and told(3) == [1, 2]


def test_close_calls_keep_all_edges(spark, monkeypatch):
    """The rows of a point nearest to a crossing: distinct edges, ranks from 1 on, probabilities of a sum of 1."""
    rows = [(1, 1, 1, 0, 30.59, 114.30, 5.0, None, None, "x", "WGS84"), (2, 1, 2, 0, 30.59, 114.30, 5.0, None, float("inf"), "x", "WGS84")]
    monkeypatch.setattr(roads, "_points", lambda *_: spark.createDataFrame(rows, COLUMNS))
    c = roads._cand(spark, "").groupBy("id").agg(F.countDistinct("edge_id").alias("n"), F.max("rank").alias("last"), F.round(F.sum("prob"), 9).alias("sum"))
    got = {r["id"]: tuple(r)[1:] for r in c.collect()}
    assert got[1] == (4, 4, 1.0) and got[2][:2] == (4, 4)

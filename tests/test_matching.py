"""Map matching on small graphs against a plain version that works with scalars."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tests.plain_matching import Plain

from trailmill.functions import geo
from trailmill.functions.text import FAST
from trailmill.operators import matching, regions, roads, routing

RAW = "edge_id long, way_id long, start_node long, end_node long, lat1 double, lng1 double, lat2 double, lng2 double, name string, type string, one_way boolean, max_speed int, layer int, bridge boolean, tunnel boolean, ramp boolean"


def town(seed: int = 1) -> list[tuple]:
    """A grid of streets of 200 m, some one-way, some without a name, with a raised road beside one."""
    r = random.Random(seed)
    n = 5
    node = lambda i, j: i * n + j + 1
    at = lambda i, j: (30.59 + i * 0.0018, 114.30 + j * 0.0021)
    rows = []
    for i in range(n):
        for j in range(n):
            for di, dj, way in ((0, 1, 100 + i), (1, 0, 200 + j)):
                if i + di < n and j + dj < n and r.random() > 0.08:
                    k = len(rows) + 1
                    kind = r.choice(["primary", "secondary", "residential", "primary_link", "motorway"])
                    rows.append((k, way, node(i, j), node(i + di, j + dj), *at(i, j), *at(i + di, j + dj), "未命名道路" if k % 6 == 0 else f"R{way}", kind, k % 5 == 0, 50, 0, False, False, kind.endswith("link")))
    for j in range(n - 1):  # a bridge 20 m north of the middle street, joined to it at its ends alone
        a = node(2, 0) if j == 0 else 90 + j
        b = node(2, n - 1) if j == n - 2 else 91 + j
        lat = lambda x: 30.59 + 2 * 0.0018 + (0.00018 if x >= 90 else 0.0)
        rows.append((900 + j, 300, a, b, lat(a), 114.30 + j * 0.0021, lat(b), 114.30 + (j + 1) * 0.0021, "R102", "primary", False, 50, 1, True, False, False))
    return rows


def tracks(seed: int, trips: int = 6) -> list[tuple]:
    r = random.Random(seed)
    rows, k = [], 0
    for trip in range(trips):
        lat, lng, ts = 30.5905 + r.random() * 0.006, 114.301 + r.random() * 0.006, 1_700_000_000_000
        h = r.choice([0.0, 90.0, 180.0, 270.0])
        for i in range(r.choice([9, 12, 14])):
            stay = 4 <= i <= 7 and trip % 2 == 0
            if not stay:
                h = (h + r.choice([0, 0, 0, 90, -90])) % 360
                lat, lng = lat + 0.0007 * math.cos(math.radians(h)) + r.gauss(0, 0.00004), lng + 0.0008 * math.sin(math.radians(h)) + r.gauss(0, 0.00004)
            k += 1
            ts += 10_000
            rows.append((k, 1, trip, ts, lat, lng, 10.0, 0.4 if stay else 7.0, None if k % 4 == 0 else h))
    rows.append((k + 1, 1, 97, 1_700_000_000_000, 30.592, 114.303, 10.0, 5.0, 90.0))  # a point alone
    rows += [(k + 2 + i, 1, 98, 1_700_000_000_000 + i * 10_000, 30.592, 114.303, 10.0, 0.2, 90.0) for i in range(4)]  # one stay
    rows += [(k + 9 + i, 1, 99, 1_700_000_000_000 + i * 10_000, 30.62 + i * 0.001, 114.303, 10.0, 5.0, 90.0) for i in range(3)]  # far from any road
    return rows


@pytest.fixture(scope="module")
def small(spark):
    edges = roads.finish_edges(spark.createDataFrame(town(), RAW))
    points = spark.createDataFrame(tracks(3), "id long, user_id long, trip_id long, ts long, lat double, lng double, accuracy_m double, speed_mps double, heading_deg double")
    plain = Plain([r.asDict() for r in edges.collect()])
    by_trip: dict = {}
    for p in points.orderBy("trip_id", "ts", "id").collect():
        by_trip.setdefault(p["trip_id"], []).append(p.asDict())
    return points, edges, plain, by_trip


def test_fast_types_are_those_of_the_plain_version():
    from tests import plain_matching

    assert set(FAST) == plain_matching.FAST


@pytest.mark.parametrize("order", ["first", "second", "adaptive"])
def test_match_equals_plain(small, order):
    points, edges, plain, by_trip = small
    got = {r["id"]: r for r in matching.match(points, edges, order=order).collect()}
    assert len(got) == points.count()
    complex_points = 0
    for trip, pts in by_trip.items():
        for i, _, edge, lat, lng, confidence, _ in plain.match(pts, order):
            r = got[i]
            assert (r["trip_id"], r["edge_id"]) == (trip, edge), (order, trip, i)
            assert (r["m_lat"], r["m_lng"], r["confidence"]) == pytest.approx((lat, lng, confidence), abs=1e-9)
            complex_points += r["complex"]
    assert (complex_points > 0) == (order != "first")
    assert got[by_trip[97][0]["id"]]["confidence"] == 0.1 and {got[p["id"]]["edge_id"] for p in by_trip[98] + by_trip[99]} == {None}


def test_match_in_several_parts_is_the_same(small, monkeypatch):
    points, edges, _, _ = small
    whole = sorted(map(str, matching.match(points, edges).collect()))
    own = regions.regions_of
    monkeypatch.setattr(regions, "regions_of", lambda boxes, cover: own(boxes, cover, 20, 30))
    assert sorted(map(str, matching.match(points, edges).collect())) == whole


def test_a_long_trip_meets_the_roads_of_its_corridor(spark):
    """500 km across a lattice of roads that fills the box of the trip: the same match as with all roads of the box,
    from roads that grow with the length of the trip."""
    n, step = 320, 0.0125
    at = lambda i, j: (F.lit(29.5) + i * step, F.lit(109.5) + j * step)
    cells = spark.range(n * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))
    i, j = F.col("i"), F.col("j")
    parts = []
    for k, (a, b) in enumerate(((0, 1), (1, 0))):
        (lat1, lng1), (lat2, lng2) = at(i, j), at(i + a, j + b)
        parts.append(cells.select((2 * (i * n + j) + k).alias("edge_id"), (i if k == 0 else j + n).alias("way_id"), (i * n + j).alias("start_node"), ((i + a) * n + j + b).alias("end_node"), lat1.alias("lat1"), lng1.alias("lng1"), lat2.alias("lat2"), lng2.alias("lng2"), F.lit("R").alias("name"), F.lit("primary").alias("type"), F.lit(False).alias("one_way"), F.lit(50).alias("max_speed"), F.lit(0).alias("layer"), F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"), F.lit(False).alias("ramp")))
    edges = matching.materialise(roads.finish_edges(parts[0].union(parts[1])), "lattice")
    points = spark.range(400).select("id", F.lit(1).cast("long").alias("user_id"), F.lit(7).cast("long").alias("trip_id"), (F.col("id") * 60_000).alias("ts"), (F.lit(30.0) + F.col("id") * 0.0078).alias("lat"), (F.lit(110.0) + F.col("id") * 0.0084).alias("lng"), F.lit(10.0).alias("accuracy_m"), F.lit(20.0).alias("speed_mps"), F.lit(45.0).alias("heading_deg"))
    boxes = regions.network_boxes(points)
    cover = regions.corridors(points, boxes)
    parts_of = regions.regions_of(boxes, cover)
    loaded = regions.roads_of(parts_of, cover, edges).select("edge_id").distinct()
    box = boxes.first()
    whole = edges.filter(F.greatest("lat1", "lat2").between(box["south"], box["north"]) & F.greatest("lng1", "lng2").between(box["west"], box["east"])).count()
    assert loaded.count() < whole / 5 and parts_of.select("_part").distinct().count() == 1
    near = roads.within(points.select("id", "lat", "lng"), edges, 5000.0).select("edge_id").distinct()
    assert near.join(loaded, "edge_id", "left_anti").count() == 0
    found = sorted(map(str, matching.match(points, edges).collect()))
    all_of_box = sorted(map(str, matching.match(points, edges, matching.MatchParams(corridor_km=600.0)).collect()))
    assert found == all_of_box and sum("edge_id=None" not in x for x in found) > 50


def test_ways_of_a_part_are_found_together(small, monkeypatch):
    """One look at the graph for all ways of a part, and the same rows as trip by trip."""
    points, edges, *_ = small
    m = matching.match(points, edges).select("trip_id", "id", "ts", "edge_id", "m_lat", "m_lng", "m_offset").toArrow()
    e, calls, ways = edges.select(*routing.FIELDS).toArrow(), [], routing.RoadGraph.ways
    monkeypatch.setattr(routing.RoadGraph, "ways", lambda self, *a: calls.append(len(a[0])) or ways(self, *a))
    whole = matching._rebuilt_part(m, e, matching.DEFAULTS)
    assert len(calls) == 1 and calls[0] > 10
    trips = sorted(set(m.column("trip_id").to_pylist()))
    alone = [r for t in trips for r in matching._rebuilt_part(m.filter(pc.equal(m.column("trip_id"), t)), e, matching.DEFAULTS).to_pylist()]
    assert whole.to_pylist() == alone and len(alone) > 100


def test_rebuilt_way_and_quality_equal_plain(small):
    points, edges, plain, by_trip = small
    m = matching.match(points, edges)
    rebuilt = matching.reconstruct(m, edges)
    rows: dict = {}
    for r in rebuilt.orderBy("trip_id", "pos").collect():
        rows.setdefault(r["trip_id"], []).append((r["ts"], r["lat"], r["lng"]))
    quality = {r["trip_id"]: r for r in matching.quality(m, rebuilt).collect()}
    for trip, pts in by_trip.items():
        matched = plain.match(pts)
        want = plain.rebuild(matched)
        assert np.allclose(np.array(rows[trip]), np.array(want), atol=1e-9), trip
        snap = sorted(Plain_step(p, x) for p, x in zip(pts, matched, strict=True))
        assert quality[trip]["avg_snap"] == pytest.approx(sum(snap) / len(snap), abs=1e-6)
        assert quality[trip]["p90_snap"] == pytest.approx(snap[min(len(snap) - 1, int(len(snap) * 0.9))], abs=1e-6)
        assert quality[trip]["bad_ratio"] == pytest.approx(sum(s > 30 for s in snap) / len(snap))
    assert len(rows[97]) == 1


def Plain_step(p, x):
    from tests.plain_matching import dist

    return dist(p["lat"], p["lng"], x[3], x[4])


@pytest.fixture(scope="module")
def graph(small):
    t = small[1].select(*routing.FIELDS).toArrow()
    return routing.RoadGraph({c: t.column(c).to_numpy() for c in routing.FIELDS})


def test_routes_between_all_pairs_of_places(small, graph):
    plain = small[2]
    by_id = {e["edge_id"]: e for e in plain.edges}
    r = random.Random(5)
    ids = sorted(by_id)
    pairs = [(r.choice(ids), r.random() * 200, r.choice(ids), r.random() * 200) for _ in range(250)]
    i, oi, j, oj = (np.array(x) for x in zip(*((graph.index[a], x, graph.index[b], y) for a, x, b, y in pairs), strict=True))
    metres, _ = graph.ways(i, oi, j, oj)
    for (a, x, b, y), m in zip(pairs, metres.tolist(), strict=True):
        want = plain.way(by_id[a], x, by_id[b], y)
        assert (want is None and math.isinf(m)) or want[0] == pytest.approx(m, abs=1e-6)


def test_edge_paths_on_the_toy_graph(spark):
    """Four nodes, three two-way edges: 1-2, 2-3, 2-4."""
    at = {1: (30.2741, 120.1551), 2: (30.2745, 120.1560), 3: (30.2738, 120.1565), 4: (30.2750, 120.1570)}
    rows = [(k, k, a, b, *at[a], *at[b], f"R{k}", "secondary", False, 50, 0, False, False, False) for k, (a, b) in enumerate(((1, 2), (2, 3), (2, 4)), 1)]
    edges = roads.finish_edges(spark.createDataFrame(rows, RAW))
    t = edges.select(*routing.FIELDS).toArrow()
    g = routing.RoadGraph({c: t.column(c).to_numpy() for c in routing.FIELDS})
    assert len(g.at) == 4 and len(g.c["edge_id"]) == 3
    a, b = g.index[1], g.index[2]
    assert g.path(1, 3)[1] == [1, 2, 3] and g.metres(np.array([1]), np.array([2]))[0] > 0
    assert [int(g.c["edge_id"][e]) for e in g.edge_path(a, b)] == [2]  # of the ends that differ, 2 and 3 are the nearest
    assert g.edge_path(a, a) == [a] and g.road_distance(a, a) == 0.0
    assert g.road_distance(a, b) == pytest.approx(float(g.c["length_m"][b])) and g.c["length_m"][b] < g.c["length_m"][a]
    alone = routing.RoadGraph({c: np.concatenate((v, v[:1])) if c not in ("edge_id", "start_node", "end_node") else np.concatenate((v, np.array([{"edge_id": 9, "start_node": 70, "end_node": 71}[c]]))) for c, v in g.c.items()})
    assert alone.edge_path(alone.index[9], alone.index[2]) == [] and alone.road_distance(alone.index[9], alone.index[2]) == 100_000.0
    near = roads.within(spark.createDataFrame([(1, 30.2742, 120.1552)], "id long, lat double, lng double"), edges, 100.0)
    assert near.count() >= 1


def test_roads_far_north(spark):
    """At 70 degrees a degree of longitude is a third of one at the equator."""
    rows = [(k, k, 2 * k, 2 * k + 1, 69.99, 20.0 + k * 0.004, 70.01, 20.0 + k * 0.004, "R", "primary", False, 50, 0, False, False, False) for k in range(6)]
    p = spark.createDataFrame([(k, 70.0, 20.0 + k * 0.004 + s * 0.00205) for k in range(6) for s in (-1, 1)], "id long, lat double, lng double")
    near = roads.within(p, spark.createDataFrame(rows, RAW), 80.0)
    assert near.filter(F.col("id") == F.col("edge_id")).count() == 12


def test_regions_of_points_without_a_shuffle_by_place(spark):
    """Smallest box, ties by name, repeated and null ids, places outside and without coordinates; places are not dealt by cell."""
    from trailmill.operators import roads

    boxes = spark.createDataFrame([("big", 0.0, 10.0, 0.0, 10.0), ("b", 2.0, 3.0, 2.0, 3.0), ("a", 2.0, 3.0, 2.0, 3.0)], "name string, south double, north double, west double, east double")
    rows = [(1, 2.5, 2.5), (1, 5.0, 5.0), (None, 2.0, 3.0), (2, 50.0, 5.0), (3, None, 5.0), (4, 10.0, 10.0)]
    got = roads.region_of_points(spark.createDataFrame(rows, "id long, lat double, lng double"), boxes)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(*r, g) for r, g in zip(rows, ("a", "big", "a", None, None, "big"), strict=True)], "id long, lat double, lng double, region string").collect()))
    many = roads.region_of_points(spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("lat"), F.lit(2.5).alias("lng")), boxes)
    assert "SortMergeJoin" not in many._jdf.queryExecution().executedPlan().toString() and many.filter("region is not null").count() == 1000


def test_road_search_is_compiled(spark):
    """Methods of more than 8000 bytes are never compiled by the JVM; pieces of no length count by their point."""
    p = spark.createDataFrame([(1, 30.0, 114.0), (2, 30.001, 114.0005), (3, 31.0, 114.0)], "id long, lat double, lng double")
    e = spark.createDataFrame([(1, 30.0005, 114.0, 30.0005, 114.0), (2, 30.0, 114.0, 30.0, 114.002)], "edge_id long, lat1 double, lng1 double, lat2 double, lng2 double")
    near = roads.within(p, e, 120.0)
    plain = p.crossJoin(e).withColumn("pr", geo.segment_projection("lat", "lng", "lat1", "lng1", "lat2", "lng2")).filter("pr.distance <= 120")
    rows = lambda d: sorted(map(str, d.select("id", "edge_id", "pr").collect()))
    assert rows(near) == rows(plain) and near.count() == 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        it = roads.within(p, e, 120.0)._jdf.queryExecution().debug().codegenToSeq().iterator()
        sizes = []
        while it.hasNext():
            sizes.append(it.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(sizes) < 8000

"""Routes through the overlay against a search of the whole graph."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators import overlay, roads

RAW = "edge_id long, way_id long, start_node long, end_node long, lat1 double, lng1 double, lat2 double, lng2 double, name string, type string, one_way boolean, max_speed int, layer int, bridge boolean, tunnel boolean, ramp boolean"


def network(seed: int, n: int = 90, m: int = 200):
    """Random nodes, each joined to some near ones, many one-way; some parts can't be left or reached."""
    r = random.Random(seed)
    at = {k: (30 + r.random() * 0.3, 114 + r.random() * 0.3) for k in range(n)}
    rows = []
    for k in range(m):
        a = r.randrange(n)
        near = sorted((x for x in at if x != a), key=lambda x: (at[x][0] - at[a][0]) ** 2 + (at[x][1] - at[a][1]) ** 2)[:8]
        rows.append((k, k, a, (b := r.choice(near)), *at[a], *at[b], "R", "primary", r.random() < 0.4, 50, 0, False, False, False))
    return rows


def plain(adjacency, source):
    out: dict = {}
    for a, b, w in adjacency:
        out.setdefault(a, []).append((b, w))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > best[n]:
            continue
        for b, w in out.get(n, ()):
            if d + w < best.get(b, float("inf")):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize(("seed", "most"), [(1, 12), (3, 1000)])
def test_equals_a_search_of_the_whole_graph(spark, seed, most):
    edges = overlay.materialise(roads.finish_edges(spark.createDataFrame(network(seed), RAW)), "random")
    arcs = [(r["from_node"], r["to_node"], r["length_m"]) for r in roads.adjacency(edges).collect()]
    o = overlay.build(edges, most)
    sizes = [r["count"] for r in o.cells.groupBy("cell").count().collect()]
    assert max(sizes) <= most and (len(sizes) == 1) == (most == 1000)
    r = random.Random(seed)
    pairs = [(r.randrange(90), r.randrange(90)) for _ in range(120)] + [(5, 5), (5, 5), (1, 5000), (None, 3)]
    got = {(x["source"], x["target"]): x["metres"] for x in overlay.metres_between(o, spark.createDataFrame(pairs, "source long, target long")).collect()}
    known = {n for a, b, _ in arcs for n in (a, b)}
    assert set(got) == {p for p in pairs if None not in p}
    for (a, b), m in got.items():
        want = plain(arcs, a).get(b) if a in known and b in known else None
        assert (m is None) == (want is None), (a, b)
        assert m is None or m == pytest.approx(want, rel=1e-9)
    assert sum(m is not None for m in got.values()) > 30
    near = {(x["source"], x["target"]): x["metres"] for x in overlay.metres_between(o, spark.createDataFrame(pairs, "source long, target long"), 12_000.0).collect()}
    assert near == {k: m if m is not None and m <= 12_000 else None for k, m in got.items()}


def test_empty(spark):
    edges = overlay.materialise(roads.finish_edges(spark.createDataFrame(network(4), RAW)), "random")
    o = overlay.build(edges, 20)
    assert overlay.metres_between(o, spark.createDataFrame([], "source long, target long")).count() == 0
    none = overlay.build(edges.filter(F.lit(False)))
    assert [tuple(r) for r in overlay.metres_between(none, spark.createDataFrame([(1, 2)], "source long, target long")).collect()] == [(1, 2, None)]


def moved(spark) -> int:
    """Rows that this session has shuffled so far."""
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def line(n: int):
    """A road with a node every 200 metres or so."""
    at = lambda k: (30.0, 114.0 + k * 0.002)
    return [(k, k, k, k + 1, *at(k), *at(k + 1), "R", "primary", False, 50, 0, False, False, False) for k in range(n)]


def test_rounds_leave_jumps_where_they_are(spark):
    """A round with few places moves these and what they meet, and not all jumps."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = overlay.build(overlay.materialise(roads.finish_edges(spark.createDataFrame(line(20), RAW)), "line"), 8)
        far = spark.range(1_000_000, 1_010_000).selectExpr("id from_node", "id + 1 to_node", "1d metres")
        o.jumps = overlay.materialise(o.jumps.unionByName(far), "jumps")
        before = moved(spark)
        got = overlay.metres_between(o, spark.createDataFrame([(0, 18)], "source long, target long")).collect()
        assert got[0]["metres"] == pytest.approx(sum(r["length_m"] for r in roads.finish_edges(spark.createDataFrame(line(18), RAW)).collect()), rel=1e-9)
        assert moved(spark) - before < 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_nodes_move_once_to_find_their_cells(spark):
    nodes = overlay.materialise(spark.range(4000).selectExpr("id node_id", "30 + id % 61 * 0.002 lat", "114 + id * 0.0001 lng"), "nodes").repartition(4)
    before = moved(spark)
    cells = overlay.cells_of(nodes, 50).groupBy("cell").count().collect()
    assert sum(r["count"] for r in cells) == 4000 and max(r["count"] for r in cells) <= 50
    assert moved(spark) - before < 4 * 4000


def test_pieces_come_from_the_row_of_their_way(spark):
    """Two ways of one id, nodes twice, unknown nodes, a way of one node: pieces as before, and none between two ways."""
    nodes = spark.createDataFrame([(k, 30.0 + k * 0.001, 114.0) for k in range(6)], "id long, lat double, lng double")
    ways = spark.createDataFrame([(1, [0, 1, 2], {"highway": "primary"}), (1, [3, 4], {"highway": "service", "oneway": "yes"}), (2, [5], {"highway": "primary"}), (3, [2, 9, 3, 3], {"highway": "track"}), (4, [0, 5], {"highway": "footway"})], "id long, node_ids array<long>, tags map<string,string>")
    got = sorted((r["start_node"], r["end_node"], r["one_way"]) for r in roads.routable(nodes, ways).collect())
    assert got == [(0, 1, False), (1, 2, False), (3, 3, False), (3, 4, True)]
    assert sorted((r["start_node"], r["end_node"], r["type"]) for r in roads.whole_network(nodes, ways).collect()) == [(0, 1, "primary"), (1, 2, "primary"), (3, 3, "track"), (3, 4, "service")]

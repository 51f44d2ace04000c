"""Roads: search, candidates, network building, routing, map matching."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from trailmill.operators import clean, matching, overlay, roads, routing
from trailmill.plans import trip_map
from trailmill.queries.sqltext import EDGES, FILL, PLACE, TOWN_EDGES, TOWN_NODES, TOWN_WAYS, TP, hav
from trailmill.queries.tracks import NEAR
from trailmill.scratch import materialise, scratch_root
from trailmill.sources import pbf
from trailmill.sources.tables import derived, read, road_edges, town_ways

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _edges(spark):
    """Finished edges as a stored table: its true size then decides which side of a join is sent."""
    return materialise(roads.finish_edges(road_edges(spark)), "edges")


def _points(spark, sf):
    return derived(spark, sf, "track")


_Q = f"q as (select id, trip_id, ts, lat, lng from {TP})"


@register("radius_search", f"with {_Q}, {NEAR} select id, edge_id, round(pd, 3) distance from near where pd <= 80")
def radius_search(spark, sf):
    return roads.within(_points(spark, sf), _edges(spark), 80.0).select("id", "edge_id", F.round("pr.distance", 3).alias("distance"))


@register("nearest_road", f"with {_Q}, {NEAR} select q.id, round(min(pd), 3) road_m from q left join near on near.id = q.id and pd <= 60 group by q.id")
def nearest_road(spark, sf):
    return roads.nearest_distance(_points(spark, sf), _edges(spark)).select("id", F.round("road_m", 3).alias("road_m"))


@register("in_network", f"with {_Q}, {NEAR} select distinct id from near where pd <= 25")
def in_network(spark, sf):
    return roads.in_network(_points(spark, sf), _edges(spark), 25.0).select("id")


@register("point_coverage_top10", f"with {_Q}, {NEAR} select id, cast(rank as int) rank, edge_id, round(pd, 3) distance from (select *, row_number() over (partition by id order by round(pd, 9), edge_id) rank from near where pd <= 200) where rank <= 10")
def point_coverage_top10(spark, sf):
    from pyspark.sql import Window

    near = roads.within(_points(spark, sf).select("id", "lat", "lng"), _edges(spark), 200.0)
    w = Window.partitionBy("id").orderBy(F.round("pr.distance", 9), "edge_id")
    return near.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("id", "rank", "edge_id", F.round("pr.distance", 3).alias("distance"))


@register("coverage_percentiles", f"""with {_Q}, {NEAR}, d as (select q.id, q.trip_id, min(pd) m from q left join near on near.id = q.id and pd <= 60 group by q.id, q.trip_id),
 g as (select trip_id, count(*) points, count(*) filter (m is null) uncovered, count(*) filter (m is null or m > 40) suspicious, list(m order by m) filter (m is not null) l from d group by trip_id)
 select trip_id, points, uncovered, suspicious, {', '.join(f'round(l[cast(floor((len(l) - 1) * {q}) as int) + 1], 3) {n}' for n, q in (('p50', '0.5e0'), ('p90', '0.9e0'), ('p95', '0.95e0'), ('p99', '0.99e0')))} from g""")
def coverage_percentiles(spark, sf):
    c = roads.coverage(_points(spark, sf), _edges(spark), 60.0)
    return c.withColumns({x: F.round(x, 3) for x in ("p50", "p90", "p95", "p99")})


# --- the town: a network of the orders, which grows with them


def _town(spark, sf):
    """Finished edges of the town, written once."""
    return materialise(roads.whole_network(derived(spark, sf, "town_node"), town_ways(spark, sf)), "town")


_DEG = "dg as (select node_id, count(*) degree from (select unnest([start_node, end_node]) node_id from e) group by node_id)"
_TOWN = f"with recursive e as materialized (select * from {TOWN_EDGES}), {_DEG}"


@register("node_degree", f"{_TOWN} select node_id, degree from dg")
def node_degree(spark, sf):
    return roads.node_degrees(_town(spark, sf))


@register("ramp_heuristic", f"{_TOWN} select edge_id, cast(greatest(a.degree, b.degree) as int) node_degree, ramp or (one_way and {hav('lat1', 'lng1', 'lat2', 'lng2')} <= 220 and greatest(a.degree, b.degree) >= 3 and type in ('trunk', 'primary', 'secondary', 'unclassified', 'service')) ramp from e join dg a on a.node_id = start_node join dg b on b.node_id = end_node")
def ramp_heuristic(spark, sf):
    return roads.whole_network(derived(spark, sf, "town_node"), town_ways(spark, sf)).select("edge_id", "node_degree", "ramp")


@register("adjacency_union", f"{_TOWN} select edge_id, false reverse, start_node from_node, end_node to_node from e union all select edge_id, true, end_node, start_node from e where not one_way")
def adjacency_union(spark, sf):
    return roads.adjacency(_town(spark, sf)).select("edge_id", "reverse", "from_node", "to_node")


@register("shared_nodes", f"{_TOWN}, x as (select edge_id, unnest([start_node, end_node]) node_id from e) select distinct a.edge_id, b.edge_id other_id from x a join x b on a.node_id = b.node_id and a.edge_id < b.edge_id")
def shared_nodes(spark, sf):
    ends = _town(spark, sf).select("edge_id", F.explode(F.array("start_node", "end_node")).alias("node_id"))
    other = ends.withColumnRenamed("edge_id", "other_id")
    return ends.join(other, "node_id").filter("edge_id < other_id").select("edge_id", "other_id").distinct()


@register("highway_histogram", f"select type, count(*) n from {TOWN_EDGES} group by type")
def highway_histogram(spark, sf):
    return _town(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# --- candidates

_THETA = "case when heading_deg is null then -1e0 when one_way then d1 else least(d1, d2) end"


def _diff(a: str, b: str) -> str:
    d = f"(abs({a} - {b}) % 360)"
    return f"(case when {d} > 180 then 360 - {d} else {d} end)"


CAND = f"""
t as (select * from {TP}), {FILL}, q as (select id, lat, lng from f), {NEAR},
c0 as (select near.*, f.trip_id, f.heading_deg, {_diff('f.heading_deg', 'direction')} d1, {_diff('f.heading_deg', '((direction + 180) % 360)')} d2, min(pd) over (partition by near.id) > 120 wide from near join f on f.id = near.id where pd <= 260),
c1 as (select *, {_THETA} theta from c0),
c2 as (select *, greatest(exp(-0.5e0 * pow(pd / 20, 2)) / (20 * sqrt(2 * pi())) * case when theta < 0 then 1e0 else exp(-0.5e0 * pow(theta / 45, 2)) / (45 * sqrt(2 * pi())) end, 1e-12) * case when wide then 0.72e0 else 1e0 end raw_prob
  from c1 where case when wide then not (theta >= 0 and pd > 40 and theta > 35) else pd <= 120 end),
c3 as (select *, row_number() over (partition by id order by raw_prob desc, pd, edge_id) rank from c2),
c4 as (select *, greatest(raw_prob, 1e-12) / sum(greatest(raw_prob, 1e-12)) over (partition by id) prob from c3 where rank <= 4)"""


def _cand(spark, sf):
    return matching.candidates(clean.fill_heading_and_speed(_points(spark, sf), "heading_from"), _edges(spark), 4)


@register("candidates_topk", f"with {CAND} select id, edge_id, round(pd, 3) distance, round(theta, 3) theta, round(off, 3) \"offset\" from c4")
def candidates_topk(spark, sf):
    return _cand(spark, sf).select("id", "edge_id", *(F.round(c, 3).alias(c) for c in ("distance", "theta", "offset")))


@register("candidate_prob_norm", f"with {CAND} select id, cast(rank as int) rank, round(prob, 6) prob from c4")
def candidate_prob_norm(spark, sf):
    return _cand(spark, sf).select("id", "rank", F.round("prob", 6).alias("prob"))


@register("candidates_best_per_way", f"with {CAND} select id, way_id, round(max(raw_prob), 9) best from c2 group by id, way_id")
def candidates_best_per_way(spark, sf):
    c = matching.likely(clean.fill_heading_and_speed(_points(spark, sf)), _edges(spark))
    return c.join(road_edges(spark).select("edge_id", "way_id"), "edge_id").groupBy("id", "way_id").agg(F.round(F.max("raw_prob"), 9).alias("best"))


@register("heading_gate", f"with {CAND} select id, count(*) n, bool_or(wide) wide from c2 group by id")
def heading_gate(spark, sf):
    c = matching.likely(clean.fill_heading_and_speed(_points(spark, sf)), _edges(spark))
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("n"), (F.min("distance") > 120).alias("wide"))


#: Grades are compared to three decimals: they are distances from a mean in deviations of variances, and the
#: engines sum these in orders of their own.
_GRADES = f"""{_Q}, dg as (select node_id, count(*) degree from (select unnest([start_node, end_node]) node_id from {EDGES}) group by node_id), {NEAR},
 k as (select near.*, greatest(a.degree, b.degree) dgr from near join dg a on a.node_id = start_node join dg b on b.node_id = end_node where pd <= 40),
 pr as (select a.id, abs(least({_diff('a.direction', 'b.direction')}, 180 - {_diff('a.direction', 'b.direction')})) d from k a join k b on a.id = b.id and a.edge_id < b.edge_id),
 v as (select id, var_pop(d) variance from pr group by id), m as (select id, max(dgr) dgr, count(*) n from k group by id),
 nd as (select id, count(distinct x) nodes from (select id, unnest([start_node, end_node]) x from k) group by id),
 g0 as (select q.trip_id, q.id, q.ts, variance, coalesce((variance > 0 and variance < 0.5) or dgr >= 4, false) is_complex, case when n is null then 0e0 else greatest(0e0, least(1e0, 0.5e0 * (1 + 2e0 * n / nodes / n))) end connectivity,
  avg(variance) over (partition by q.trip_id) mu, coalesce(stddev_pop(variance) over (partition by q.trip_id), 0) sd from q left join v using (id) left join m using (id) left join nd using (id)),
 g1 as (select *, case when variance is null then 0e0 when sd < 1e-9 then greatest(0e0, least(1e0, 1 - 0.5e0 * variance)) else greatest(0e0, least(1e0, 1 - 0.5e0 * abs((variance - mu) / sd))) end directional from g0),
 g2 as (select *, greatest(directional, connectivity) complexity, max(cast(is_complex as int)) over (partition by trip_id order by ts, id rows between 2 preceding and 2 following) = 1 complex_segment from g1),
 g3 as (select *, sum(new) over (partition by trip_id order by ts, id rows between unbounded preceding and current row) segment from (select *, case when complex_segment <> lag(complex_segment) over (partition by trip_id order by ts, id) then 1 else 0 end new from g2))"""


@register("complexity", f"with {_GRADES} select trip_id, id, round(variance, 4) variance, is_complex from g3")
def complexity(spark, sf):
    return roads.complexity(_points(spark, sf), _edges(spark)).select("trip_id", "id", F.round("variance", 4).alias("variance"), "is_complex")


@register("complexity_grades", f"with {_GRADES} select trip_id, id, round(directional, 3) directional, round(connectivity, 3) connectivity, round(complexity, 3) complexity, complex_segment, cast(segment as int) segment from g3")
def complexity_grades(spark, sf):
    c = roads.complexity(_points(spark, sf), _edges(spark))
    return c.select("trip_id", "id", *(F.round(x, 3).alias(x) for x in ("directional", "connectivity", "complexity")), "complex_segment", "segment")


@register("complex_segments", f"with {_GRADES} select trip_id, cast(segment as int) segment, complex_segment, count(*) points, round(avg(complexity), 3) mean_complexity from g3 group by trip_id, segment, complex_segment")
def complex_segments(spark, sf):
    c = roads.complexity(_points(spark, sf), _edges(spark))
    return c.groupBy("trip_id", "segment", "complex_segment").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("complexity"), 3).alias("mean_complexity"))


# --- building a network from ways

@register("osm_tag_parse", f"select id, name, type, one_way, max_speed, layer, bridge, tunnel, ramp, drivable from {TOWN_WAYS}")
def osm_tag_parse(spark, sf):
    return town_ways(spark, sf).select("id", *roads.road_attributes(F.col("tags")), roads.drivable(F.col("tags")).alias("drivable"))


#: Half the sides of the box to extract around the middle of the town, and of the wider one, in degrees.
_HALF, _WIDER = 0.0305, 0.02
_IN = lambda h: f"lat between 30.59e0 - {h} and 30.59e0 + {h} and lng between 114.3e0 - {h} and 114.3e0 + {h}"
_EXTRACT = f"""with e as materialized (select * from {TOWN_EDGES}), w as (select id, unnest(list_transform(range(n), lambda i: first + i * step)) node_id from {TOWN_WAYS} where drivable),
 t as (select distinct w.id from w join {TOWN_NODES} x on x.id = node_id where {_IN(_HALF + _WIDER)})
 select edge_id, way_id, start_node, end_node, round({hav('lat1', 'lng1', 'lat2', 'lng2')}, 3) length_m, name, type, one_way from e where way_id in (select id from t)
 and least(lat1, lat2) <= 30.59e0 + {_HALF} and greatest(lat1, lat2) >= 30.59e0 - {_HALF} and least(lng1, lng2) <= 114.3e0 + {_HALF} and greatest(lng1, lng2) >= 114.3e0 - {_HALF}"""


def _extracted(nodes, ways):
    e = roads.extract_network(nodes, ways, 30.59 - _HALF, 30.59 + _HALF, 114.3 - _HALF, 114.3 + _HALF, _WIDER)
    return e.select("edge_id", "way_id", "start_node", "end_node", F.round("length_m", 3).alias("length_m"), "name", "type", "one_way")


@register("extract_network", _EXTRACT)
def extract_network(spark, sf):
    return _extracted(derived(spark, sf, "town_node"), town_ways(spark, sf))


def _map_file(spark, sf):
    """The town as a folder of map files in the scratch folder: nodes by rows of the map, then streets."""
    path = f"{scratch_root(spark)}/map-{uuid.uuid4().hex}"
    pbf.write_pbf(derived(spark, sf, "town_node").repartitionByRange("lat").sortWithinPartitions("lat", "lng"), path, block_rows="500")
    pbf.write_pbf(town_ways(spark, sf), path)
    return path


@register("pbf_network", _EXTRACT)
def pbf_network(spark, sf):
    """The same network, from map files written and read again: each block is decoded once, whatever the joins read."""
    path = _map_file(spark, sf)
    return _extracted(materialise(pbf.read_nodes(spark, path), "nodes"), materialise(pbf.read_ways(spark, path), "ways"))


@register("pbf_box", f"select id, round(lat, 6) lat, round(lng, 6) lng from {TOWN_NODES} where {_IN(_HALF)}")
def pbf_box(spark, sf):
    """Crossings of a box, from the blocks of the map files that can hold one."""
    path = _map_file(spark, sf)
    index = materialise(pbf.block_index(spark, path), "blocks")
    n = pbf.read_nodes(spark, path, (30.59 - _HALF, 30.59 + _HALF, 114.3 - _HALF, 114.3 + _HALF), index)
    return n.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@register("shortest_path_hops", f"""{_TOWN}, ad as (select start_node a, end_node b, {hav('lat1', 'lng1', 'lat2', 'lng2')} m from e union all select end_node, start_node, {hav('lat1', 'lng1', 'lat2', 'lng2')} from e where not one_way),
 r as (select min(start_node) node, 0e0 m, 0 h from e where start_node >= (select count(*) // 2 from {TOWN_NODES}) union all select b, min(r.m + ad.m), h + 1 from r join ad on a = node where h < 12 group by b, h) select node, round(min(m), 3) metres from r group by node""")
def shortest_path_hops(spark, sf):
    e = _town(spark, sf)
    first = e.filter(F.col("start_node") >= derived(spark, sf, "town_node").count() // 2).agg(F.min("start_node")).first()[0]
    return routing.hop_distances(roads.adjacency(e), first, 12).select("node", F.round("metres", 3).alias("metres"))


_BOXES = (("hubei", 29.0, 33.3, 108.2, 116.1), ("hunan", 24.6, 30.1, 108.8, 114.7), ("henan", 31.4, 36.4, 110.4, 116.6), ("town", 30.2, 30.6, 114.1, 114.4), ("quarter", 30.35, 30.45, 114.3, 114.6), ("far", 40.0, 41.0, 10.0, 11.0))


#: Metres up to which routes are looked for.
_ROUTE_M = 4000.0


@register("town_routes")
def town_routes(spark, sf):
    """For every customer the way from one crossing to another some streets away."""
    n = derived(spark, sf, "town_node").count()
    side = math.ceil(math.sqrt(n))
    at = (F.col("c_custkey") * 31) % n
    pairs = read(spark, sf, "customer").select(at.alias("source"), ((at + 3 + 2 * side * (F.col("c_nationkey") % 3 - 1)) % n).alias("target"))
    streets = materialise(roads.routable(derived(spark, sf, "town_node"), town_ways(spark, sf)), "streets")
    return overlay.metres_between(overlay.build(streets, 500), pairs, _ROUTE_M).select("source", "target", F.round("metres", 3).alias("metres"))


@register("region_of_position", f"""with c as (select trip_id id, (min(lat) + max(lat)) / 2 + trip_id % 3 lat, (min(lng) + max(lng)) / 2 lng from {TP} group by trip_id) select c.id, name region from c left join (select * from (select c.id, name, row_number() over (partition by c.id order by (n - s) * (e - w), name) k from c
 join (values {', '.join(map(str, _BOXES))}) v(name, s, n, w, e) on lat between s and n and lng between w and e) where k = 1) b on b.id = c.id""")
def region_of_position(spark, sf):
    """The region whose map file a trip needs: the smallest box that holds the middle of the trip."""
    c = _points(spark, sf).groupBy(F.col("trip_id").alias("id")).agg(((F.min("lat") + F.max("lat")) / 2 + F.col("trip_id") % 3).alias("lat"), ((F.min("lng") + F.max("lng")) / 2).alias("lng"))
    return roads.region_of_points(c, spark.createDataFrame(list(_BOXES), "name string, south double, north double, west double, east double")).select("id", "region")


@register("region_of_places", f"""select p.id, name region from {PLACE} p left join (select * from (select p.id, name, row_number() over (partition by p.id order by (n - s) * (e - w), name) k from {PLACE} p
 join (values {', '.join(map(str, _BOXES))}) v(name, s, n, w, e) on lat + id % 3 between s and n and lng between w and e) where k = 1) b on b.id = p.id""")
def region_of_places(spark, sf):
    p = derived(spark, sf, "place").select("id", (F.col("lat") + F.col("id") % 3).alias("lat"), "lng")
    return roads.region_of_points(p, spark.createDataFrame(list(_BOXES), "name string, south double, north double, west double, east double")).select("id", "region")


@register("sparse_network", f"{_TOWN} select count(*) < 2000 or (select count(*) from dg) < 1500 sparse from e")
def sparse_network(spark, sf):
    return roads.sparse(_town(spark, sf), 2.5)


# --- matching


def _matched(spark, sf, order: str):
    return matching.match(clean.driving(_points(spark, sf)), _edges(spark), order=order)


def _rounded(m):
    return m.select("trip_id", "id", "edge_id", "road", *(F.round(c, 6).alias(c) for c in ("m_lat", "m_lng")), *(F.round(c, 3).alias(c) for c in ("snap_m", "confidence")), "complex")


@register("match_first_order")
def match_first_order(spark, sf):
    return _rounded(_matched(spark, sf, "first"))


@register("match_second_order")
def match_second_order(spark, sf):
    return _rounded(_matched(spark, sf, "second"))


@register("match_adaptive")
def match_adaptive(spark, sf):
    return _rounded(_matched(spark, sf, "adaptive"))


@register("reconstruct_path")
def reconstruct_path(spark, sf):
    r = matching.reconstruct(_matched(spark, sf, "adaptive"), _edges(spark))
    return r.select("trip_id", "pos", "ts", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@register("match_quality")
def match_quality(spark, sf):
    m, e = _matched(spark, sf, "adaptive"), _edges(spark)
    q = matching.quality(m, matching.reconstruct(m, e))
    return q.select("trip_id", "points", "poor", *(F.round(c, 3).alias(c) for c in ("avg_snap", "p90_snap", "bad_ratio", "raw_m", "road_m", "detour_ratio", "score")))


def _digest(line: str):
    """A line as text, six decimals and milliseconds each."""
    at = lambda x: F.concat_ws(",", F.format_number(x["lat"], 6), F.format_number(x["lng"], 6), x["ts"].cast("string"))
    return F.array_join(F.transform(line, at), ";")


@register("trip_polylines")
def trip_polylines(spark, sf):
    lines = trip_map.segment_lines(_points(spark, sf), _edges(spark))
    return trip_map.segment_polylines(lines).withColumn("line", _digest("line"))


@register("trip_map")
def trip_map_view(spark, sf):
    v = trip_map.map_view(_points(spark, sf), _edges(spark), derived(spark, sf, "place"))
    whole = [F.struct(F.col(f"{la}.points"), F.col(f"{la}.distance_m"), F.sha2(_digest(f"{la}.line"), 256).alias("line")).alias(la) for la in ("raw", "matched", "reconstructed")]
    return v.select(*(c for c in v.columns if c not in ("raw", "matched", "reconstructed", "stretches", "markers")), *whole, F.greatest(F.size("stretches"), F.lit(0)).alias("stretches"), F.greatest(F.size("markers"), F.lit(0)).alias("markers"))

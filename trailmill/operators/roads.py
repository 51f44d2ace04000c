"""The road graph as tables: building it, searching it by radius, and what that search says of tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.functions.text import UNNAMED
from trailmill.scratch import materialise

#: Types of roads that cars may use.
VEHICLE = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "service", "living_street", "track")
#: Types whose short one-way pieces at junctions count as ramps.
RAMP_TYPES = ("trunk", "primary", "secondary", "unclassified", "service")
RAMP_M, RAMP_DEGREE = 220.0, 3
#: Bits of an edge's id that number the pieces of a way.
WAY_BITS = 20


def highway_type(tags: Column) -> Column:
    """The ``highway`` tag; for a road under construction the type it will have, if cars may use that."""
    kind, later = F.trim(tags["highway"]), F.trim(tags["construction"])
    return F.when(kind == "", None).when(F.lower(kind) != "construction", kind).when(later.isin(*VEHICLE), later)


def drivable(tags: Column) -> Column:
    """A type for cars, not closed to motor vehicles, and not closed at all unless a destination service."""
    no = lambda k: F.coalesce(F.lower(tags[k]) == "no", F.lit(False))
    return F.coalesce(highway_type(tags).isin(*VEHICLE), F.lit(False)) & ~no("motor_vehicle") & (~no("access") | F.coalesce(F.lower(tags["service"]) == "destination", F.lit(False)))


def road_attributes(tags: Column) -> list[Column]:
    """name, type, one_way, max_speed, layer, bridge, tunnel, ramp."""
    is_set = lambda k: F.coalesce(F.lower(tags[k]) != "no", F.lit(False))
    digits = F.regexp_replace(tags["maxspeed"], "[^0-9]", "")
    return [
        F.coalesce(tags["name"], F.lit(UNNAMED)).alias("name"),
        highway_type(tags).alias("type"),
        F.coalesce(F.lower(tags["oneway"]).isin("yes", "1", "true"), F.lit(False)).alias("one_way"),
        F.coalesce(digits.try_cast("int"), F.lit(50)).alias("max_speed"),
        F.coalesce(F.trim(tags["layer"]).try_cast("int"), F.lit(0)).alias("layer"),
        is_set("bridge").alias("bridge"),
        is_set("tunnel").alias("tunnel"),
        (F.coalesce(F.endswith(tags["highway"], F.lit("_link")), F.lit(False)) | F.coalesce(F.lower(tags["junction"]).isin("slip_road", "ramp"), F.lit(False))).alias("ramp"),
    ]


def extract_network(nodes: DataFrame, ways: DataFrame, south: float, north: float, west: float, east: float, margin: float = 0.02) -> DataFrame:
    """Edges of the ways that touch a box: nodes of the wider box are seeds, ways with a seed are kept
    whole, and of their pieces those whose box meets the box.

    ``nodes``: id, lat, lng; ``ways``: id, node_ids, tags. Three joins: a semi-join of exploded ways
    with the seeds, and two of the pieces with the nodes.
    """
    seeds = nodes.filter(geo.in_box("lat", "lng", south - margin, north + margin, west - margin, east + margin)).select("id")
    flat = ways.filter(drivable(F.col("tags"))).select(F.col("id").alias("way_id"), F.explode("node_ids").alias("node_id"))
    touched = flat.join(seeds, flat["node_id"] == seeds["id"], "left_semi").select("way_id").distinct()
    e = _pieces(ways.join(touched, ways["id"] == touched["way_id"], "left_semi"), nodes)
    return finish_edges(e.filter(geo.boxes_meet(F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), F.least("lng1", "lng2"), F.greatest("lng1", "lng2"), south, north, west, east)))


def whole_network(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Edges of all ways that cars may use."""
    return finish_edges(_pieces(ways, nodes))


def routable(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """What routes need of all ways that cars may use: ends, their positions, ``one_way`` and ``length_m``. No degrees are
    counted, and no other column goes through the joins."""
    e = _pieces(ways, nodes)
    return e.select("start_node", "end_node", "lat1", "lng1", "lat2", "lng2", "one_way", geo.haversine("lat1", "lng1", "lat2", "lng2").alias("length_m"))


def _pieces(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of ways that cars may use, without degree and length; pieces with an unknown node
    are left out. A way has its nodes with it, so its pieces come from its own row; tags are read there too.

    The id comes from the way and the place in it: no global numbering, so no single partition. A way has
    2000 nodes at most; 20 bits leave room for more.
    """
    tags, n = F.col("tags"), F.col("node_ids")
    ends = F.arrays_zip(n.alias("a"), F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))).alias("b"))
    w = ways.filter(drivable(tags)).select(F.col("id").alias("way_id"), *road_attributes(tags), F.posexplode(ends).alias("seq", "_ends"))
    attributes = [c for c in w.columns if c not in ("way_id", "seq", "_ends")]
    e = w.select((F.shiftleft("way_id", WAY_BITS) + F.col("seq")).alias("edge_id"), "way_id", F.col("_ends.a").alias("start_node"), F.col("_ends.b").alias("end_node"), *attributes).filter("end_node is not null")
    at = lambda p, k: nodes.select(F.col("id").alias(f"{p}_node"), F.col("lat").alias(f"lat{k}"), F.col("lng").alias(f"lng{k}"))
    e = e.join(at("start", 1), "start_node").join(at("end", 2), "end_node")
    return e.select("edge_id", "way_id", "start_node", "end_node", "lat1", "lng1", "lat2", "lng2", *attributes)


def node_degrees(edges: DataFrame) -> DataFrame:
    """``node_id, degree``: ends of edges at each node."""
    return edges.select(F.explode(F.array("start_node", "end_node")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def finish_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``length_m``, ``direction``, ``node_degree`` (the larger of its ends) and ramps also
    where a short one-way piece meets a junction."""
    d = node_degrees(edges)
    e = edges.join(d.withColumnsRenamed({"node_id": "start_node", "degree": "_d1"}), "start_node").join(d.withColumnsRenamed({"node_id": "end_node", "degree": "_d2"}), "end_node")
    e = e.select(*edges.columns, geo.haversine("lat1", "lng1", "lat2", "lng2").alias("length_m"), geo.bearing("lat1", "lng1", "lat2", "lng2").alias("direction"), F.greatest("_d1", "_d2").cast("int").alias("node_degree"))
    short = F.col("one_way") & (F.col("length_m") <= RAMP_M) & (F.col("node_degree") >= RAMP_DEGREE) & F.col("type").isin(*RAMP_TYPES)
    return e.withColumn("ramp", F.col("ramp") | short)


def adjacency(edges: DataFrame) -> DataFrame:
    """``edge_id, reverse, from_node, to_node, length_m``: edges, and two-way ones backwards as well."""
    both = edges.select("edge_id", F.lit(False).alias("reverse"), F.col("start_node").alias("from_node"), F.col("end_node").alias("to_node"), "length_m")
    back = edges.filter(~F.col("one_way")).select("edge_id", F.lit(True).alias("reverse"), F.col("end_node").alias("from_node"), F.col("start_node").alias("to_node"), "length_m")
    return both.unionAll(back)


def within(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Pairs of points and edges within ``radius`` metres: the columns of both and ``pr``, the projection.

    Edges go to every grid cell that their box, grown by the radius, covers, and a point to its own:
    an equality join, where a comparison of coordinates would meet every point with every edge. Cells
    are as high as the radius; how wide the ones of a row are depends on its latitude, so that no pair
    is lost anywhere.
    """
    high = radius / geo.DEGREE_M * 1.01  # a little more than a degree's metres differ
    row = lambda c: F.floor(c / high)
    # Towards a pole cells are as wide as the far side of their row needs; at the pole one is the whole row.
    edge_of_row = F.least(F.greatest(F.abs("_y"), F.abs(F.col("_y") + 1)) * high, F.lit(89.9))
    wide = high / F.cos(F.radians(edge_of_row))
    col = lambda c: F.floor(c / wide)
    e = edges.withColumn("_y", F.explode(F.sequence(row(F.least("lat1", "lat2") - high), row(F.greatest("lat1", "lat2") + high))))
    e = e.withColumn("_x", F.explode(F.sequence(col(F.least("lng1", "lng2") - wide), col(F.greatest("lng1", "lng2") + wide))))
    p = points.withColumn("_y", row(F.col("lat"))).withColumn("_x", col(F.col("lng")))
    return geo.project_within(p.join(e, ["_y", "_x"]).drop("_y", "_x"), radius)


def nearest_distance(points: DataFrame, edges: DataFrame, radius: float = 60.0) -> DataFrame:
    """``points`` with ``road_m``, metres to the nearest road within ``radius``, else null."""
    near = within(points.select("id", "lat", "lng"), edges, radius).groupBy("id").agg(F.min("pr.distance").alias("road_m"))
    return points.join(near, "id", "left").select(*points.columns, "road_m")


def in_network(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Points with any road within ``radius``."""
    return points.join(within(points.select("id", "lat", "lng"), edges, radius).select("id").distinct(), "id", "left_semi")


def nearest_edges(points: DataFrame, edges: DataFrame, radius: float, most: int = 10) -> DataFrame:
    """The ``most`` nearest edges of each point: ``id, rank, edge_id, name, type, distance``."""
    w = Window.partitionBy("id").orderBy(F.col("pr.distance"), "edge_id")
    near = within(points.select("id", "lat", "lng"), edges, radius).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return near.select("id", "rank", "edge_id", "name", "type", F.col("pr.distance").alias("distance"))


def coverage(points: DataFrame, edges: DataFrame, radius: float, suspicious_m: float = 40.0) -> DataFrame:
    """For each trip: points, those without a road, the share that is far from one, and percentiles of
    the distance to the nearest one, at the lower of two ranks."""
    d = nearest_distance(points, edges, radius)
    sorted_m = F.array_sort(F.collect_list("road_m"))
    at = lambda q: F.get("_d", F.floor((F.size("_d") - 1) * q).cast("int"))
    far = F.col("road_m").isNull() | (F.col("road_m") > suspicious_m)
    g = d.groupBy("trip_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("road_m").isNull()).alias("uncovered"), F.count_if(far).alias("suspicious"), sorted_m.alias("_d"))
    return g.select("trip_id", "points", "uncovered", "suspicious", *(at(q).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))))


def complexity(points: DataFrame, edges: DataFrame, radius: float = 40.0, degree: int = 4) -> DataFrame:
    """``trip_id, id, ts, variance, directional, connectivity, complexity, is_complex, segment``.

    ``variance`` is that of the angles between all pairs of roads near a point (null for fewer than
    two), ``directional`` falls with its distance from the trip's mean; points without a variance
    don't enter mean and deviation. Complex points widen by two to either side; ``segment`` numbers
    the runs of complex and simple points.
    """
    near = within(points.select("id", "lat", "lng"), edges, radius)
    roads = near.groupBy("id").agg(
        F.sort_array(F.collect_list("direction")).alias("_d"),
        F.max("node_degree").alias("_degree"),
        F.count(F.lit(1)).alias("_k"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array("start_node", "end_node"))))).alias("_nodes"),
    )
    apart = F.flatten(F.transform("_d", lambda a, i: F.transform(F.slice("_d", i + 2, F.size("_d")), lambda b: F.abs(F.least(geo.angle_difference(a, b), 180.0 - geo.angle_difference(a, b))))))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    roads = roads.withColumn("_a", apart).withColumn("_m", mean(F.col("_a"))).withColumn("variance", F.expr("try_divide(aggregate(_a, 0D, (s, x) -> s + (x - _m) * (x - _m)), size(_a))"))
    p = points.select("trip_id", "id", "ts").join(roads.select("id", "variance", "_degree", "_k", "_nodes"), "id", "left")
    trip = Window.partitionBy("trip_id")
    mu, sd = F.avg("variance").over(trip), F.stddev_pop("variance").over(trip)
    directional = F.when(F.col("variance").isNull(), 0.0).when(F.col("_sd") < 1e-9, geo.clamp(1.0 - 0.5 * F.col("variance"), 0.0, 1.0)).otherwise(geo.clamp(1.0 - 0.5 * F.abs((F.col("variance") - F.col("_mu")) / F.col("_sd")), 0.0, 1.0))
    linked = F.when(F.col("_k").isNull(), 0.0).otherwise(geo.clamp(0.5 * (1.0 + 2.0 * F.col("_k") / F.col("_nodes") / F.col("_k")), 0.0, 1.0))
    p = p.withColumns({"_mu": mu, "_sd": F.coalesce(sd, F.lit(0.0))}).withColumns({"directional": directional, "connectivity": linked})
    p = p.withColumn("complexity", F.greatest("directional", "connectivity")).withColumn("is_complex", F.coalesce(((F.col("variance") > 0) & (F.col("variance") < 0.5)) | (F.col("_degree") >= degree), F.lit(False)))
    along = Window.partitionBy("trip_id").orderBy("ts", "id")
    p = p.withColumn("_wide", F.max(F.col("is_complex").cast("int")).over(along.rowsBetween(-2, 2)))
    p = p.withColumn("_new", F.coalesce((F.col("_wide") != F.lag("_wide").over(along)).cast("int"), F.lit(0)))
    return p.select("trip_id", "id", "ts", "variance", "directional", "connectivity", "complexity", "is_complex", (F.col("_wide") == 1).alias("complex_segment"), F.sum("_new").over(along).cast("int").alias("segment"))


def histogram(edges: DataFrame, most: int = 12) -> DataFrame:
    """``rank, type, n``: the ``most`` frequent types of roads."""
    n = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "type").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "type"))).select("rank", "type", "n")


def around(nodes: DataFrame, ways: DataFrame, lat: float, lng: float, radius_km: float, buffer_km: float = 4.0) -> DataFrame:
    """The network around a position."""
    km = radius_km + buffer_km
    dlat, dlng = km / 111.0, km / max(1e-6, 111.0 * math.cos(math.radians(lat)))
    return extract_network(nodes, ways, lat - dlat, lat + dlat, lng - dlng, lng + dlng)


def around_or_wider(nodes: DataFrame, ways: DataFrame, lat: float, lng: float, radius_km: float, factor: float = 1.8) -> DataFrame:
    """The network around a position; where that is too thin for a town, one of ``factor`` times the radius
    if it has more edges. Both are written, since they are counted before one is chosen."""
    first = materialise(around(nodes, ways, lat, lng, radius_km), "network")
    if not sparse(first, radius_km).first()["sparse"]:
        return first
    second = materialise(around(nodes, ways, lat, lng, radius_km * factor), "network")
    return second if second.count() > first.count() else first


def in_region(boxes: DataFrame, lat: float, lng: float) -> DataFrame:
    """The smallest of the overlapping boxes (``name, south, north, west, east``) that holds a position."""
    inside = boxes.filter(geo.in_box(F.lit(lat), F.lit(lng), F.col("south"), F.col("north"), F.col("west"), F.col("east")))
    area = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))
    return inside.orderBy(area, "name").limit(1)


def region_of_points(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points`` with ``region``, the name of the smallest of the overlapping boxes that holds each, or null.
    Boxes go to every degree cell that they cover, and all of a cell to each point in it. They are few and sent to
    every task: most points lie in few cells, which a shuffle would give to few tasks."""
    size = ((F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))).alias("size")
    b = boxes.select(F.struct(size, *boxes.columns).alias("b"), F.explode(F.sequence(F.floor("south"), F.floor("north"))).alias("_y"), "west", "east")
    b = b.select("b", "_y", F.explode(F.sequence(F.floor("west"), F.floor("east"))).alias("_x"))
    cells = b.groupBy("_y", "_x").agg(F.collect_list(F.struct("b.size", *(f"b.{c}" for c in ("name", "south", "north", "west", "east")))).alias("_boxes"))
    holds = lambda x: geo.in_box(F.col("lat"), F.col("lng"), x["south"], x["north"], x["west"], x["east"])
    p = points.withColumns({"_y": F.floor("lat"), "_x": F.floor("lng")}).join(F.broadcast(cells), ["_y", "_x"], "left")
    return p.select(*points.columns, F.array_min(F.filter("_boxes", holds))["name"].alias("region"))


def sparse(edges: DataFrame, radius_km: float, least_edges: int = 2000, least_nodes: int = 1500) -> DataFrame:
    """One row ``sparse``: whether a network loaded for 2 km or more is too thin for a town."""
    nodes = node_degrees(edges).agg(F.count(F.lit(1)).alias("n"))
    return edges.agg(F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(nodes)).select((F.lit(radius_km >= 2.0) & ((F.col("m") < least_edges) | (F.col("n") < least_nodes))).alias("sparse"))

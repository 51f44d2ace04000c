"""The map of a trip: raw track, walking and driving stretches, matched and rebuilt lines, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geo, text
from trailmill.operators import clean, matching, motion, roads, trips
from trailmill.operators.grouped import filter_groups
from trailmill.params import COLORS, DEFAULTS, WIDTHS, MatchParams
from trailmill.scratch import materialise

#: A stretch has a trip number of its own in the operators: trip and stretch side by side.
SHIFT = 20


def display(lat: str, lng: str) -> Column:
    """Positions as drawn: in the offset system."""
    return geo.wgs_to_gcj(lat, lng)


def stretches(points: DataFrame, edges: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """Cleaned points with ``mode`` and ``segment``; sensor headings and speeds are left out of account if
    ``use_sensor_fields`` is off. Trips of fewer than two cleaned points have none."""
    raw = points if p.use_sensor_fields else points.withColumns({"heading_deg": F.lit(None).cast("double"), "speed_mps": F.lit(None).cast("double"), "accuracy_m": F.lit(10.0)})
    # written, so that the filling of headings reads positions: it would repeat the formula of the shift until
    # the code of its stage is too long to be compiled
    c = clean.general(materialise(clean.to_wgs84(raw), "positions"), p)
    c = materialise(c.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trip_id"))).filter("_n > 1").drop("_n"), "cleaned")
    modes = motion.classify(motion.evidence(roads.nearest_distance(c, edges, p.road_search), p), p)
    return materialise(c.join(modes.select("trip_id", "id", "mode", "segment"), ["trip_id", "id"]), "stretches")


def segment_lines(points: DataFrame, edges: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, layer, segment, mode, pos, ts, lat, lng``: the line of each stretch in the layers matched and
    reconstructed, as drawn.

    A driving stretch of fewer than two points after its cleaning is drawn as it came, as is a walking
    one of none. With ``quality_fallback`` a stretch whose match is poor is drawn as it was cleaned.
    """
    edges = materialise(edges, "edges")
    s = stretches(points, edges, p)
    own = materialise(s.withColumn("_trip", F.col("trip_id")).withColumn("trip_id", F.shiftleft("trip_id", SHIFT) + F.col("segment")), "own")
    names = own.select("trip_id", "_trip", "segment", "mode").distinct()
    of = lambda mode: own.filter(F.col("mode") == mode).drop("_trip", "mode", "segment")
    walk = materialise(clean.walking(of("WALKING"), p), "walks")
    drive = materialise(clean.driving(of("DRIVING"), p), "drives")
    few = drive.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("trip_id")
    drive = drive.join(few, "trip_id", "left_semi").select(*drive.columns)
    m = matching.match(drive, edges, p)
    rebuilt = materialise(matching.reconstruct(m, edges, p), "rebuilt")
    plain = lambda d: d.select("trip_id", "ts", "id", "lat", "lng")
    matched, again = m.select("trip_id", "ts", "id", F.col("m_lat").alias("lat"), F.col("m_lng").alias("lng")), rebuilt.select("trip_id", "ts", F.col("pos").cast("long").alias("id"), "lat", "lng")
    left = own.join(walk.select("trip_id").union(few).distinct(), "trip_id", "left_anti")
    parts = {"matched": [plain(left), plain(walk)], "reconstructed": [plain(left), plain(walk)]}
    if p.quality_fallback:
        poor = matching.quality(m, rebuilt).filter("poor").select("trip_id")
        as_is = plain(drive.join(poor, "trip_id", "left_semi"))
        matched, again = (x.join(poor, "trip_id", "left_anti") for x in (matched, again))
        parts = {k: [*v, as_is] for k, v in parts.items()}
    whole = None
    for layer, found in (("matched", [*parts["matched"], matched]), ("reconstructed", [*parts["reconstructed"], again])):
        for x in found:
            rows = x.select(F.lit(layer).alias("layer"), "trip_id", "ts", "id", "lat", "lng")
            whole = rows if whole is None else whole.unionByName(rows)
    w = Window.partitionBy("trip_id", "layer").orderBy("ts", "id")
    whole = whole.join(names, "trip_id").withColumns({"_d": display("lat", "lng"), "pos": F.row_number().over(w)})
    return whole.select(F.col("_trip").alias("trip_id"), "layer", "segment", "mode", "pos", "ts", F.col("_d.lat").alias("lat"), F.col("_d.lng").alias("lng"))


def _measured(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``keys, points, distance_m, line``: lines as arrays in order, with their lengths."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = lines.withColumns({"_s": geo.haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng"), "_i": F.row_number().over(w)})
    line = F.transform(F.array_sort(F.collect_list(F.struct("_i", "lat", "lng", "ts"))), lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"), x["ts"].alias("ts")))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.floor(F.coalesce(F.sum("_s"), F.lit(0.0)) + 0.5).cast("long").alias("distance_m"), line.alias("line"))


def segment_polylines(lines: DataFrame) -> DataFrame:
    """``trip_id, layer, segment, mode, color, width, points, distance_m, line``: stretches of two points at least."""
    g = _measured(lines, ["trip_id", "layer", "segment", "mode"], ["pos"]).filter("points > 1")
    style = F.create_map(*(F.lit(x) for (la, m), c in COLORS.items() for x in (f"{la} {m}", c)))
    width = F.create_map(*(F.lit(x) for la, v in WIDTHS.items() for x in (la, v)))
    return g.withColumn("color", F.try_element_at(style, F.concat_ws(" ", "layer", "mode"))).withColumn("width", F.try_element_at(width, F.col("layer")))


def whole_polylines(points: DataFrame, lines: DataFrame) -> DataFrame:
    """``trip_id, layer, points, distance_m, line`` for the layers raw, matched and reconstructed.

    Raw are all valid points. The others join the stretches; a point that repeats the last drawn one in
    time within 1.5 m is left out. Where a layer has nothing, the one before it is drawn.
    """
    raw = clean.to_wgs84(points.filter(geo.valid("lat", "lng"))).withColumn("_d", display("lat", "lng"))
    raw = raw.select("trip_id", F.lit("raw").alias("layer"), F.lit(0).alias("segment"), "id", "ts", F.col("_d.lat").alias("lat"), F.col("_d.lng").alias("lng"))
    r = _measured(raw, ["trip_id", "layer"], ["ts", "id"])
    drawn = filter_groups(lines.select("trip_id", "layer", "segment", "pos", "ts", "lat", "lng"), ["trip_id", "layer"], ["segment", "pos"], clean.keep_for_display)
    found = _measured(drawn, ["trip_id", "layer"], ["segment", "pos"])
    every = r.select("trip_id", F.explode(F.array(F.lit("matched"), F.lit("reconstructed"))).alias("layer"))
    own = every.join(found, ["trip_id", "layer"], "left")
    instead = r.select("trip_id", *(F.col(c).alias(f"_{c}") for c in ("points", "distance_m", "line")))
    own = own.join(instead, "trip_id").select("trip_id", "layer", *(F.coalesce(c, f"_{c}").alias(c) for c in ("points", "distance_m", "line")))
    return r.unionByName(own)


def markers(place: DataFrame) -> DataFrame:
    """``trip_id, markers``: the places of each trip in order of start and id, as they are pinned on a map."""
    p = place.filter(geo.valid("lat", "lng"))
    pin = F.struct("start_time", "id", F.concat(F.lit("place-"), F.col("id").cast("string")).alias("key"), "lat", "lng", F.col("poi_name").alias("title"), text.duration_text(F.col("duration_sec")).alias("subtitle"))
    return p.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(pin)), lambda x: F.struct(*(x[c].alias(c) for c in ("key", "lat", "lng", "title", "subtitle")))).alias("markers"))


def map_view(points: DataFrame, edges: DataFrame, place: DataFrame | None = None, p: MatchParams = DEFAULTS) -> DataFrame:
    """One row for each trip: box, centre and zoom of the points as they are stored, each layer as a
    struct of points, distance and line, the stretches of the two upper layers, and markers."""
    lines = materialise(segment_lines(points, edges, p), "lines")
    whole = whole_polylines(points, lines).withColumn("_l", F.struct("points", "distance_m", "line"))
    g = whole.groupBy("trip_id").pivot("layer", ["raw", "matched", "reconstructed"]).agg(F.first("_l"))
    part = F.struct("layer", "segment", "mode", "color", "width", "points", "distance_m", "line")
    s = segment_polylines(lines).groupBy("trip_id").agg(F.array_sort(F.collect_list(part)).alias("stretches"))
    out = trips.boxes(points).join(g, "trip_id", "left").join(s, "trip_id", "left")
    return out if place is None else out.join(markers(place), "trip_id", "left")


def trip_detail(trip: DataFrame, points: DataFrame, edges: DataFrame, place: DataFrame, story: DataFrame, summary: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """One row for each trip: its own columns, how many places it has, its map, places, story blocks in the
    order of their time, and its stored summary or the line told instead."""
    in_order = lambda df, order, *cols: df.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("_a"))
    places = in_order(place, ("start_time", "id"), "poi_name", "lat", "lng", "duration_sec").select("trip_id", F.col("_a").alias("places"))
    blocks = in_order(story.filter(~F.coalesce("is_hidden", F.lit(False))), ("sort_time", "sort_index", "id"), "block_type", "ref_type", "ref_id", "title").select("trip_id", F.col("_a").alias("blocks"))
    view = map_view(points, edges, place, p)
    t = trip.withColumn("trip_id", F.col("id")).join(places, "trip_id", "left").join(blocks, "trip_id", "left").join(summary.select("trip_id", "overview"), "trip_id", "left")
    t = t.join(view.select("trip_id", F.struct(*(c for c in view.columns if c != "trip_id")).alias("map")), "trip_id", "left")
    return t.withColumns({"place_count": F.greatest(F.size("places"), F.lit(0)), "overview": F.coalesce("overview", F.concat(F.lit("这是一次"), "title", F.lit("的旅程")))}).drop("trip_id")

"""Geographic expressions over columns: distances, bearings, projections, coordinate systems, grids.

Every function takes and returns columns, so that it stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0
#: Fixed values of the Chinese offset system: ellipsoid, and the box outside which it does not apply.
GCJ_AXIS, GCJ_ECCENTRICITY = 6378245.0, 0.00669342162296594323
CHINA = {"lng": (72.004, 137.8347), "lat": (0.8293, 55.8271)}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle metres."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing, 0 to 360."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    b = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.when(b < 0, b + 360.0).otherwise(b)


def angle_difference(a, b) -> Column:
    """Between two directions, 0 to 180; 180 if either is null."""
    d = F.abs(_c(a) - _c(b)) % 360.0
    return F.coalesce(F.when(d > 180.0, 360.0 - d).otherwise(d), F.lit(180.0))


def heading_to_road(heading, direction, one_way) -> Column:
    """Difference of a heading and a road, in either direction of a two-way road."""
    ahead, back = angle_difference(heading, direction), angle_difference(heading, (_c(direction) + 180.0) % 360.0)
    return F.when(_c(one_way), ahead).otherwise(F.least(ahead, back))


def road_to_road(dir_a, one_way_a, dir_b, one_way_b) -> Column:
    """Smallest difference over the directions in which the two roads may be driven."""
    best = F.least(heading_to_road(dir_a, dir_b, one_way_b), heading_to_road((_c(dir_a) + 180.0) % 360.0, dir_b, one_way_b))
    return F.when(_c(one_way_a), heading_to_road(dir_a, dir_b, one_way_b)).otherwise(best)


def turn_angle(lat1, lng1, lat2, lng2, lat3, lng3) -> Column:
    return angle_difference(bearing(lat1, lng1, lat2, lng2), bearing(lat2, lng2, lat3, lng3))


def gaussian(x, sigma: float) -> Column:
    z = _c(x) / sigma
    return F.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))


def clamp(x, low, high) -> Column:
    return F.greatest(_c(low), F.least(_c(high), _c(x)))


def speed(distance_m, dt_ms) -> Column:
    """Metres a second; 0 unless time passed."""
    return F.when(_c(dt_ms) > 0, _c(distance_m) / (_c(dt_ms) / 1000.0)).otherwise(0.0)


def valid(lat, lng) -> Column:
    """Within the ranges of coordinates."""
    lat, lng = _c(lat), _c(lng)
    return ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)


def valid_not_origin(lat, lng, within: float = 1e-8) -> Column:
    """Valid, and not the point 0, 0 that stands for a missing position."""
    return valid(lat, lng) & ~((F.abs(_c(lat)) < within) & (F.abs(_c(lng)) < within))


def segment_projection(lat, lng, lat1, lng1, lat2, lng2) -> Column:
    """struct(lat, lng, distance, offset, t): the nearest point of a segment, on a plane at the mean latitude."""
    lat, lng, lat1, lng1, lat2, lng2 = map(_c, (lat, lng, lat1, lng1, lat2, lng2))
    east = F.cos(F.radians((lat + lat1 + lat2) / 3.0)) * DEGREE_M
    dx, dy = (lng2 - lng1) * east, (lat2 - lat1) * DEGREE_M
    px, py = (lng - lng1) * east, (lat - lat1) * DEGREE_M
    size = dx * dx + dy * dy
    t = F.when(size > 0, clamp((px * dx + py * dy) / size, 0.0, 1.0)).otherwise(0.0)
    off = F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
    return F.struct(
        (lat1 + t * (lat2 - lat1)).alias("lat"),
        (lng1 + t * (lng2 - lng1)).alias("lng"),
        F.when(size > 0, off).otherwise(haversine(lat, lng, lat1, lng1)).alias("distance"),
        (F.sqrt(size) * t).alias("offset"),
        t.alias("t"),
    )


def project_within(pairs: DataFrame, radius: float) -> DataFrame:
    """Rows whose point (lat, lng) is within ``radius`` metres of their segment (lat1, lng1, lat2, lng2), with ``pr``, its
    ``segment_projection``.

    The filter takes its expressions down with it, and these would hold the cosine some forty times: methods of more than
    8000 bytes, which the JVM never compiles. So each step is the one value of an array, which no filter passes.
    """
    east = F.cos(F.radians((F.col("lat") + F.col("lat1") + F.col("lat2")) / 3.0)) * DEGREE_M
    plane = {"_dx": (F.col("lng2") - F.col("lng1")) * east, "_dy": (F.col("lat2") - F.col("lat1")) * DEGREE_M, "_px": (F.col("lng") - F.col("lng1")) * east, "_py": (F.col("lat") - F.col("lat1")) * DEGREE_M}
    at_point = F.when((F.col("lat1") == F.col("lat2")) & (F.col("lng1") == F.col("lng2")), haversine("lat", "lng", "lat1", "lng1"))
    once = lambda d, **x: d.select("*", F.inline(F.array(F.struct(*(v.alias(c) for c, v in x.items())))))
    r = once(pairs, **plane, _h=at_point)
    dx, dy, px, py, size, t = map(F.col, (*plane, "_size", "_t"))
    r = once(r, _size=dx * dx + dy * dy)
    r = once(r, _t=F.when(size > 0, clamp((px * dx + py * dy) / size, 0.0, 1.0)).otherwise(0.0))
    off = F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
    r = once(r, _d=F.when(size > 0, off).otherwise(F.coalesce("_h", off))).filter(F.col("_d") <= radius)
    pr = F.struct((F.col("lat1") + t * (F.col("lat2") - F.col("lat1"))).alias("lat"), (F.col("lng1") + t * (F.col("lng2") - F.col("lng1"))).alias("lng"), F.col("_d").alias("distance"), (F.sqrt(size) * t).alias("offset"), t.alias("t"))
    return r.select(*pairs.columns, pr.alias("pr"))


def polyline_length(points) -> Column:
    """Sum of the steps of an array of structs (lat, lng)."""
    p = _c(points)
    steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def polyline_projection(lat, lng, points) -> Column:
    """The nearest of the projections on the segments of a polyline, the first of equals: struct(distance,
    lat, lng, offset, direction). One walk along the line, which carries the length so far."""
    p = _c(points)
    place = lambda d, la, ln, o, di: F.struct(d.alias("distance"), la.alias("lat"), ln.alias("lng"), o.alias("offset"), di.alias("direction"))
    zero = F.lit(0.0)
    start = F.struct(p[0]["lat"].alias("lat"), p[0]["lng"].alias("lng"), zero.alias("run"), place(F.lit(float("inf")), zero, zero, zero, zero).alias("best"))

    def step(s: Column, x: Column) -> Column:
        q = segment_projection(lat, lng, s["lat"], s["lng"], x["lat"], x["lng"])
        here = place(q["distance"], q["lat"], q["lng"], s["run"] + q["offset"], bearing(s["lat"], s["lng"], x["lat"], x["lng"]))
        best = F.when(q["distance"] < s["best"]["distance"], here).otherwise(s["best"])
        return F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"), (s["run"] + haversine(s["lat"], s["lng"], x["lat"], x["lng"])).alias("run"), best.alias("best"))

    return F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), start, step, lambda s: s["best"])


def running_lengths(points) -> Column:
    """Metres from the start of a polyline to each of its points."""
    p = _c(points)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    steps = F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: haversine(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def slice_polyline(points, start_m, end_m) -> Column:
    """Points of a polyline between two offsets along it: the cut ends and the vertices between."""
    p = _c(points)
    at = running_lengths(p)

    def cut(offset) -> Column:
        segments = F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b"), F.slice(at, 1, F.size(p) - 1).alias("s"), F.slice(at, 2, F.size(p) - 1).alias("e"))
        hit = F.element_at(F.filter(segments, lambda x: (x["e"] >= offset)), 1)
        t = F.when(hit["e"] > hit["s"], clamp((offset - hit["s"]) / (hit["e"] - hit["s"]), 0.0, 1.0)).otherwise(0.0)
        return F.struct((hit["a"]["lat"] + t * (hit["b"]["lat"] - hit["a"]["lat"])).alias("lat"), (hit["a"]["lng"] + t * (hit["b"]["lng"] - hit["a"]["lng"])).alias("lng"))

    whole = F.element_at(at, -1)
    lo, hi = clamp(start_m, 0.0, whole), clamp(end_m, 0.0, whole)
    inside = F.transform(F.filter(F.arrays_zip(p.alias("p"), at.alias("at")), lambda x: (x["at"] > lo) & (x["at"] < hi)), lambda x: F.struct(x["p"]["lat"].alias("lat"), x["p"]["lng"].alias("lng")))
    return F.concat(F.array(cut(lo)), inside, F.array(cut(hi)))


def interpolate(lat1, lng1, lat2, lng2, steps: int) -> Column:
    """``steps`` points of a line, its start left out."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct((lat1 + (lat2 - lat1) * (i / float(steps))).alias("lat"), (lng1 + (lng2 - lng1) * (i / float(steps))).alias("lng")))


def outside_china(lat, lng) -> Column:
    return ~(_c(lng).between(*CHINA["lng"]) & _c(lat).between(*CHINA["lat"]))


def _waves(v: Column, parts: tuple[tuple[float, float], ...]) -> Column:
    """Two thirds of a sum of sines: (amplitude, half period) each."""
    return sum((a * F.sin(v * (math.pi / h)) for a, h in parts), F.lit(0.0)) * (2.0 / 3.0)


def gcj_shift(lat, lng) -> tuple[Column, Column]:
    """Degrees by which the offset system moves a position."""
    x, y = _c(lng) - 105.0, _c(lat) - 35.0
    ripple = _waves(x, ((20.0, 1 / 6), (20.0, 1 / 2)))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + ripple + _waves(y, ((20.0, 1), (40.0, 3), (160.0, 12), (320.0, 30)))
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + ripple + _waves(x, ((20.0, 1), (40.0, 3), (150.0, 12), (300.0, 30)))
    phi = F.radians(_c(lat))
    w = 1 - GCJ_ECCENTRICITY * F.sin(phi) * F.sin(phi)
    meridian = GCJ_AXIS * (1 - GCJ_ECCENTRICITY) / (w * F.sqrt(w))
    return F.degrees(north / meridian), F.degrees(east / (GCJ_AXIS / F.sqrt(w) * F.cos(phi)))


def wgs_to_gcj(lat, lng) -> Column:
    """struct(lat, lng) in the offset system; unchanged outside China."""
    dlat, dlng = gcj_shift(lat, lng)
    out = outside_china(lat, lng)
    return F.struct(F.when(out, _c(lat)).otherwise(_c(lat) + dlat).alias("lat"), F.when(out, _c(lng)).otherwise(_c(lng) + dlng).alias("lng"))


def gcj_to_wgs(lat, lng) -> Column:
    """The inverse, in one step."""
    dlat, dlng = gcj_shift(lat, lng)
    out = outside_china(lat, lng)
    return F.struct(F.when(out, _c(lat)).otherwise(_c(lat) - dlat).alias("lat"), F.when(out, _c(lng)).otherwise(_c(lng) - dlng).alias("lng"))


def grid_cell(lat, lng, metres: float) -> Column:
    """struct(y, x, lat, lng): cell of a grid whose longitude step depends on the latitude, and its centre."""
    lat, lng = _c(lat), _c(lng)
    dy = metres / DEGREE_M
    dx = metres / F.greatest(F.lit(1.0), DEGREE_M * F.cos(F.radians(lat)))
    y, x = F.floor(lat / dy), F.floor(lng / dx)
    return F.struct(y.alias("y"), x.alias("x"), ((y + 0.5) * dy).alias("lat"), ((x + 0.5) * dx).alias("lng"))


def in_box(lat, lng, south, north, west, east) -> Column:
    return _c(lat).between(_c(south), _c(north)) & _c(lng).between(_c(west), _c(east))


def boxes_meet(s1, n1, w1, e1, s2, n2, w2, e2) -> Column:
    return (_c(s1) <= _c(n2)) & (_c(n1) >= _c(s2)) & (_c(w1) <= _c(e2)) & (_c(e1) >= _c(w2))


def decode_double(b) -> Column:
    """A double of its 8 little-endian bytes; null if there are fewer."""
    h = F.hex(F.substring(_c(b), 1, 8))
    turned = F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))
    bits = F.conv(turned, 16, -10).cast("long")
    return F.when(F.octet_length(_c(b)) >= 8, F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double"))


def encode_double(x) -> Column:
    """8 little-endian bytes of a double."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), _c(x)).cast("long")
    h = F.lpad(F.hex(bits), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8))))

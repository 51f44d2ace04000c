"""Cleaning of tracks, trip by trip in order of time and id.

Rules that look at neighbours alone are windows; those that look at the last kept point are folds
over ordered groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import arrays, geo
from trailmill.operators.grouped import Group, filter_groups
from trailmill.params import DEFAULTS, MatchParams

KEYS, ORDER = ["trip_id"], ["ts", "id"]


def along():
    """The points of a trip in order. A function, since a window needs a session and workers have none."""
    return Window.partitionBy("trip_id").orderBy("ts", "id")


def accurate(points: DataFrame, most: float) -> DataFrame:
    """Valid positions whose accuracy, if known, is at most ``most``."""
    return points.filter(geo.valid_not_origin("lat", "lng") & (F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= most)))


def fill_heading_and_speed(points: DataFrame, source: str | None = None) -> DataFrame:
    """Null or negative headings become the bearing from the point before if it is 3 m away at least, else
    that to the next on the same condition; null or negative speeds that of the step from the point
    before (the first point: to the next; a lone one: 0). ``source`` names a column for what headings come
    from: struct(given, lat0, lng0, lat1, lng1), the heading before and the points before and after."""
    lat0, lng0, ts0 = (F.lag(c).over(along()) for c in ("lat", "lng", "ts"))
    lat1, lng1, ts1 = (F.lead(c).over(along()) for c in ("lat", "lng", "ts"))
    p = points.select("*", lat0.alias("_lat0"), lng0.alias("_lng0"), ts0.alias("_ts0"), lat1.alias("_lat1"), lng1.alias("_lng1"), ts1.alias("_ts1"))
    back, ahead = geo.haversine("_lat0", "_lng0", "lat", "lng"), geo.haversine("lat", "lng", "_lat1", "_lng1")
    heading = F.when(back >= 3.0, geo.bearing("_lat0", "_lng0", "lat", "lng")).when(ahead >= 3.0, geo.bearing("lat", "lng", "_lat1", "_lng1"))
    step = lambda d, a, b: d / (F.greatest(F.lit(1), b - a) / 1000.0)
    speed = F.when(F.col("_ts0").isNotNull(), step(back, F.col("_ts0"), F.col("ts"))).otherwise(F.coalesce(step(ahead, F.col("ts"), F.col("_ts1")), F.lit(0.0)))
    given_h, given_s = F.col("heading_deg"), F.col("speed_mps")
    new = {"heading_deg": F.when(given_h >= 0, given_h).otherwise(F.coalesce(heading, given_h)), "speed_mps": F.when(given_s >= 0, given_s).otherwise(speed)}
    out = [new[c].alias(c) if c in new else c for c in points.columns]
    if source:
        out.append(F.struct(given_h.alias("given"), *(F.col(f"_{c}").alias(c) for c in ("lat0", "lng0", "lat1", "lng1"))).alias(source))
    return p.select(*out)


def _scan(first: np.ndarray, again: Callable[[int, int], bool], end: int) -> np.ndarray:
    """Which points are kept, if one is dropped by what it is to the last kept one. ``first`` says so for
    the point before; only after a drop, and up to the next point that is kept, is ``again`` asked of
    (last kept, point). Points from ``end`` on stay."""
    keep = np.ones(len(first), bool)
    at = 0
    drops = np.flatnonzero(first[:end])
    while at < len(drops):
        i = int(drops[at])
        last = i - 1
        while i < end and (again(last, i) if i - last > 1 else True):
            keep[i] = False
            i += 1
        at = int(np.searchsorted(drops, i, side="right"))
    return keep


def _fold(g: Group, drop) -> np.ndarray:
    """Keeps the ends; a point between is dropped if ``drop`` says so of the last kept, it and the next: of
    metres from the first to the second, to the third and from the first to the third, and of the times."""
    n = len(g["ts"])
    if n < 3:
        return np.ones(n, bool)
    lat, lng, ts = g["lat"], g["lng"], g["ts"].astype(np.int64)
    step, two = arrays.haversine(lat[:-1], lng[:-1], lat[1:], lng[1:]), arrays.haversine(lat[:-2], lng[:-2], lat[2:], lng[2:])
    dt = np.diff(ts)
    first = np.zeros(n, bool)
    first[1:-1] = drop(np.arange(1, n - 1), step[:-1], step[1:], two, dt[:-1], dt[1:])
    la, ln, t, s = lat.tolist(), lng.tolist(), ts.tolist(), step.tolist()

    def again(last: int, i: int) -> bool:
        return bool(drop(i, arrays.metres(la[last], ln[last], la[i], ln[i]), s[i], arrays.metres(la[last], ln[last], la[i + 1], ln[i + 1]), t[i] - t[last], t[i + 1] - t[i]))

    return _scan(first, again, n - 1)


def _speed(d, ms):
    """Metres a second; 0 unless time passed."""
    return np.where(np.asarray(ms) > 0, d / (np.maximum(ms, 1) / 1000.0), 0.0)


def _close(g: Group, metres: float, in_time: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """A point is dropped within ``metres`` of the last kept one, if ``in_time`` holds for their times."""
    lat, lng, ts = g["lat"], g["lng"], g["ts"].astype(np.int64)
    first = np.zeros(len(lat), bool)
    first[1:] = arrays.haversine(lat[:-1], lng[:-1], lat[1:], lng[1:]) < metres
    if in_time:
        first[1:] &= in_time(ts[:-1], ts[1:])
    la, ln, t = lat.tolist(), lng.tolist(), ts.tolist()
    return _scan(first, lambda last, i: (in_time is None or bool(in_time(t[last], t[i]))) and arrays.metres(la[last], ln[last], la[i], ln[i]) < metres, len(lat))


def keep_after_dedup(g: Group, p: MatchParams = DEFAULTS) -> np.ndarray:
    """A point is dropped that follows the last kept one closely in both time and place."""
    return _close(g, p.dedup_m, lambda a, b: b - a < p.dedup_ms)


def keep_without_jumps(g: Group, p: MatchParams = DEFAULTS) -> np.ndarray:
    """Isolated jumps: fast there and fast back to nearly the same place."""
    return _fold(g, lambda i, a, b, c, s, t: (_speed(a, s) > p.jump_speed) & (_speed(b, t) > p.jump_speed) & (c < np.maximum(20.0, 0.4 * (a + b))))


def keep_without_drive_spikes(g: Group, p: MatchParams = DEFAULTS) -> np.ndarray:
    """Steps that no car makes, if leaving the point out leaves a step that one does."""

    def drop(i, a, b, c, s, t):
        fast = (a / (np.maximum(1, s) / 1000.0) > p.driving_speed) | (b / (np.maximum(1, t) / 1000.0) > p.driving_speed)
        return (fast | (a > p.driving_step) | (b > p.driving_step)) & (c <= p.driving_step)

    return _fold(g, drop)


def keep_without_walk_spikes(g: Group, p: MatchParams = DEFAULTS) -> np.ndarray:
    """Fast out and back, or far out and back at a poor accuracy."""
    acc = np.nan_to_num(g["accuracy_m"].astype(float))

    def drop(i, a, b, c, s, t):
        spike = (_speed(a, s) > p.walk_spike_speed) & (_speed(b, t) > p.walk_spike_speed) & (c < np.maximum(12.0, 0.45 * (a + b)))
        return spike | ((acc[i] > 60.0) & (a > 35.0) & (b > 35.0) & (c < 15.0))

    return _fold(g, drop)


def keep_simplified_walk(g: Group, p: MatchParams = DEFAULTS) -> np.ndarray:
    """Ends, and points that moved, waited or turned enough since the last kept one."""
    lat, lng, ts = g["lat"], g["lng"], g["ts"].astype(np.int64)
    n = len(lat)
    if n < 3:
        return np.ones(n, bool)
    way = arrays.bearing(lat[:-1], lng[:-1], lat[1:], lng[1:])
    first = np.zeros(n, bool)
    moved = arrays.haversine(lat[:-1], lng[:-1], lat[1:], lng[1:]) >= p.walk_move_m
    first[1:-1] = ~(moved[:-1] | (np.diff(ts)[:-1] >= p.walk_idle_ms) | (arrays.angle_difference(way[:-1], way[1:]) >= p.walk_turn))
    la, ln, t = lat.tolist(), lng.tolist(), ts.tolist()

    def again(last: int, i: int) -> bool:
        if arrays.metres(la[last], ln[last], la[i], ln[i]) >= p.walk_move_m or t[i] - t[last] >= p.walk_idle_ms:
            return False
        return bool(arrays.angle_difference(arrays.bearing(lat[last], lng[last], lat[i], lng[i]), way[i]) < p.walk_turn)

    return _scan(first, again, n - 1)


def keep_moved(g: Group, metres: float) -> np.ndarray:
    """Points at least ``metres`` from the last kept one; the first stays."""
    return _close(g, metres)


def keep_for_heatmap(g: Group) -> np.ndarray:
    """Of points of one time, those within 3 m of the last kept one go."""
    return _close(g, 3.0, lambda a, b: a == b)


def keep_for_display(g: Group) -> np.ndarray:
    """Of points of one time, those within 1.5 m of the last kept one go."""
    return _close(g, 1.5, lambda a, b: a == b)


def dedup(points: DataFrame) -> DataFrame:
    return filter_groups(points, KEYS, ORDER, keep_after_dedup)


def general(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """Accuracy, fill, repeats, jumps, fill."""

    def keep(g: Group) -> np.ndarray:
        a = keep_after_dedup(g, p)
        a[np.flatnonzero(a)] = keep_without_jumps({c: v[a] for c, v in g.items()}, p)
        return a

    return fill_heading_and_speed(filter_groups(fill_heading_and_speed(accurate(points, p.general_accuracy)), KEYS, ORDER, keep))


def driving(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """Accuracy, fill, repeats, steps that no car makes, fill."""

    def keep(g: Group) -> np.ndarray:
        a = keep_after_dedup(g, p)
        a[np.flatnonzero(a)] = keep_without_drive_spikes({c: v[a] for c, v in g.items()}, p)
        return a

    return fill_heading_and_speed(filter_groups(fill_heading_and_speed(accurate(points, p.driving_accuracy)), KEYS, ORDER, keep))


def walking(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, id, ts, lat, lng, accuracy_m, heading_deg, speed_mps``: accuracy, fill, repeats, fast steps out and
    back, fill, smoothing, stays as their means, places that say nothing new, fill. A trip of one
    point is that point."""
    from trailmill.operators import motion  # it builds on this module

    valid = points.filter(geo.valid("lat", "lng") & (F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= p.walking_accuracy)))

    def keep(g: Group) -> np.ndarray:
        a = keep_after_dedup(g, p)
        a[np.flatnonzero(a)] = keep_without_walk_spikes({c: v[a] for c, v in g.items()}, p)
        return a

    w = motion.smooth(fill_heading_and_speed(filter_groups(fill_heading_and_speed(valid), KEYS, ORDER, keep)), walking=True)
    w = filter_groups(motion.stay_centroids(w, p), KEYS, ORDER, lambda g: keep_simplified_walk(g, p))
    none = F.lit(None).cast("double")
    return fill_heading_and_speed(w.select("trip_id", "id", "ts", "lat", "lng", "accuracy_m", none.alias("heading_deg"), none.alias("speed_mps")))


def thin(points: DataFrame, most: int = 50_000, keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """Every k-th point in order, and the last, where a group has more than ``most``."""
    w = Window.partitionBy(*keys)
    p = points.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("ts", "id")) - 1)
    step = F.ceil(F.col("_n") / float(most))
    return p.filter((F.col("_n") <= most) | (F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_n", "_i")


def first_of_place_and_second(points: DataFrame) -> DataFrame:
    """The first point of each position to six decimals and second, in order."""
    w = Window.partitionBy("trip_id", F.round("lat", 6), F.round("lng", 6), F.floor(F.col("ts") / 1000)).orderBy("ts", "id")
    return points.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def to_wgs84(points: DataFrame) -> DataFrame:
    """Positions in the offset system, by ``raw_coord_type``, as WGS84; null means WGS84."""
    moved = geo.gcj_to_wgs("lat", "lng")
    gcj = F.coalesce(F.col("raw_coord_type") == "GCJ02", F.lit(False))
    p = points.withColumn("_w", F.when(gcj, moved).otherwise(F.struct("lat", "lng")))
    return p.select(*(F.col("_w")[c].alias(c) if c in ("lat", "lng") else F.lit("WGS84").alias(c) if c == "raw_coord_type" else c for c in points.columns))

"""Smoothing, walking and driving, stays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import arrays, geo
from trailmill.operators.clean import KEYS, ORDER, along
from trailmill.operators.grouped import Group, map_groups
from trailmill.params import DEFAULTS, MatchParams


def smooth(points: DataFrame, walking: bool = False) -> DataFrame:
    """``lat``, ``lng`` as means of two points to either side, weighted by 1 / (1 + places between).

    Walking weights also fall with the accuracy (null: 15 m), leave the ends as they are and are not
    scaled up when they sum to less than 1, as the results to match have it. Fewer than three points
    stay as they are.
    """
    total = F.count(F.lit(1)).over(Window.partitionBy("trip_id"))
    place = F.row_number().over(along())
    w, lat, lng = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k in (-2, -1, 0, 1, 2):
        at = lambda c, k=k: F.lag(c, -k).over(along()) if k else F.col(c)
        x = F.when(at("lat").isNotNull(), F.lit(1.0 / (1 + abs(k))))
        if walking:
            x = x / (1 + F.coalesce(at("accuracy_m"), F.lit(15.0)) / 30.0)
        w, lat, lng = w + F.coalesce(x, F.lit(0.0)), lat + F.coalesce(x * at("lat"), F.lit(0.0)), lng + F.coalesce(x * at("lng"), F.lit(0.0))
    by = F.greatest(w, F.lit(1.0)) if walking else w
    plain = (total < 3) | ((place == 1) | (place == total) if walking else F.lit(False))
    p = points.select("*", plain.alias("_plain"), (lat / by).alias("_lat"), (lng / by).alias("_lng"))
    new = {"lat": F.when(F.col("_plain"), F.col("lat")).otherwise(F.col("_lat")), "lng": F.when(F.col("_plain"), F.col("lng")).otherwise(F.col("_lng"))}
    return p.select(*(new[c].alias(c) if c in new else c for c in points.columns))


def evidence(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``points`` (with ``road_m``, metres to the nearest road or null) and what two points to either side
    say of each: ``median_speed, max_speed, near_ratio, off_ratio, stay_ratio, avg_speed, drive_score, walk_score``."""
    w = along().rowsBetween(-2, 2)
    far = F.coalesce("road_m", F.lit(float("inf")))
    ratio = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).over(w)
    five = F.array_sort(F.array_compact(F.array(*(F.lag("speed_mps", k).over(along()) for k in (2, 1)), "speed_mps", *(F.lead("speed_mps", k).over(along()) for k in (1, 2)))))
    points = points.withColumn("_five", five)
    middle = (F.get("_five", F.floor((F.size("_five") - 1) / 2).cast("int")) + F.get("_five", F.floor(F.size("_five") / 2).cast("int"))) / 2
    e = points.withColumns(
        {
            "median_speed": middle,
            "max_speed": F.greatest(F.lit(0.0), F.max("speed_mps").over(w)),
            "near_ratio": ratio(far <= p.near_road),
            "off_ratio": ratio(far >= p.off_road),
            "stay_ratio": ratio(F.col("speed_mps") <= 1.0),
            "_from": F.first(F.struct("lat", "lng", "ts")).over(w),
            "_to": F.last(F.struct("lat", "lng", "ts")).over(w),
        }
    )
    e = e.withColumn("avg_speed", geo.speed(geo.haversine(F.col("_from.lat"), F.col("_from.lng"), F.col("_to.lat"), F.col("_to.lng")), F.greatest(F.lit(1), F.col("_to.ts") - F.col("_from.ts")))).drop("_from", "_to", "_five")
    score = lambda *rules: sum((F.when(c, v).otherwise(0.0) for c, v in rules), F.lit(0.0))
    m, x, near, off, avg = (F.col(c) for c in ("median_speed", "max_speed", "near_ratio", "off_ratio", "avg_speed"))
    drive = score((m >= p.drive_median, 1.2), (x >= p.drive_max, 1.4), (avg >= 4.2, 0.8), (near >= 0.6, 0.8), ((near >= 0.8) & (m >= 2.8), 0.8))
    walk = score((m <= p.walk_median, 1.2), (x <= p.walk_max, 0.5), (off >= 0.4, 1.0), (F.col("stay_ratio") >= 0.5, 0.7), (avg <= 2.0, 0.6))
    return e.withColumns({"drive_score": drive, "walk_score": walk})


def raw_modes(ev: DataFrame) -> DataFrame:
    """``trip_id, id, ts, drives``. The evidence decides where it is clear, else the mode before, at first walking.

    A point maps the mode before it to its own. Roads that let a walk become a drive let a drive go on as well, so
    there are three such maps: to walking, to driving, and the one that leaves the mode as it was. What is composed of
    the maps up to a point is therefore the last of them that leaves nothing as it was: one window finds it.
    """
    is_ = lambda c: F.coalesce(c, F.lit(False))
    near, off, stay, med, drive, walk = (F.col(c) for c in ("near_ratio", "off_ratio", "stay_ratio", "median_speed", "drive_score", "walk_score"))
    drives = is_((F.col("max_speed") >= 9.0) & (near >= 0.4)) | is_(drive >= walk + 0.7)
    fast = is_((near >= 0.75) & (med >= 3.2))
    starts = ~(is_(med <= 2.6) | is_(off >= 0.35) | is_(stay >= 0.45)) & fast
    goes_on = is_((near >= 0.55) & (med >= 2.8)) | fast
    maps_to = F.when(drives, True).when(is_(walk >= drive + 0.4), False).when(starts, True).when(~goes_on, False)
    return ev.select("trip_id", "id", "ts", F.coalesce(F.last(maps_to, True).over(along().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)).alias("drives"))


def smooth_runs(modes: DataFrame, p: MatchParams = DEFAULTS, passes: int = 3) -> DataFrame:
    """``trip_id, run, drives, segment`` for the runs of equal modes in ``modes`` (trip_id, run, ts, drives).

    In each pass the runs of few points or little time take the mode of their neighbours, unless a run is all of
    its trip: runs alternate, so both neighbours have the same. Only one row for each run is handled.
    """
    r = modes.groupBy("trip_id", "run").agg(F.first("drives").alias("drives"), F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    r = r.withColumn("_upto", F.col("run"))
    w = Window.partitionBy("trip_id").orderBy("run")
    changes = F.sum(F.coalesce((F.col("drives") != F.lag("drives").over(w)).cast("int"), F.lit(0))).over(w)
    for _ in range(passes):
        short = (F.col("_n") < p.least_run_points) | (F.col("_t1") - F.col("_t0") < p.least_run_ms)
        r = r.withColumn("_short", short & (F.count(F.lit(1)).over(Window.partitionBy("trip_id")) > 1))
        r = r.withColumn("drives", F.col("drives") != F.col("_short"))
        r = r.withColumn("_group", F.sum(F.coalesce((F.col("drives") != F.lag("drives").over(w)).cast("int"), F.lit(0))).over(w))
        r = r.groupBy("trip_id", "_group").agg(F.first("drives").alias("drives"), F.min("run").alias("run"), F.max("_upto").alias("_upto"), F.sum("_n").alias("_n"), F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"))
    r = r.withColumn("segment", changes.cast("int"))
    return r.select("trip_id", F.explode(F.sequence("run", "_upto")).alias("run"), "drives", "segment")


def classify(ev: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, id, ts, mode_raw, mode, segment``: modes before and after smoothing, and the run of each point."""
    raw = raw_modes(ev)
    raw = raw.withColumn("_new", F.coalesce((F.col("drives") != F.lag("drives").over(along())).cast("int"), F.lit(0)))
    raw = raw.withColumn("run", F.sum("_new").over(along())).drop("_new")
    name = lambda c: F.when(F.col(c), "DRIVING").otherwise("WALKING")
    runs = smooth_runs(raw, p).withColumnRenamed("drives", "_smooth")
    return raw.join(runs, ["trip_id", "run"]).select("trip_id", "id", "ts", name("drives").alias("mode_raw"), name("_smooth").alias("mode"), "segment")


def segments(ev: DataFrame, modes: DataFrame) -> DataFrame:
    """A row for each run of a mode with its means."""
    e = ev.join(modes.select("trip_id", "id", "mode", "segment"), ["trip_id", "id"])
    return e.groupBy("trip_id", "segment", "mode").agg(
        F.count(F.lit(1)).alias("points"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"),
        F.avg("near_ratio").alias("near_ratio"), F.avg("off_ratio").alias("off_ratio"), F.avg("avg_speed").alias("avg_speed"), F.max("max_speed").alias("max_speed"),
    )


def stay_windows(g: Group, metres: float, least_ms: int, most_speed: float) -> list[tuple[int, int]]:
    """(start, end) of windows: points that stay within ``metres`` of their first for long enough and
    slowly; every other point is a window of its own."""
    lat, lng, ts, v = g["lat"].tolist(), g["lng"].tolist(), g["ts"].astype(np.int64).tolist(), g["speed_mps"].astype(float)
    near = np.append(arrays.haversine(g["lat"][:-1], g["lng"][:-1], g["lat"][1:], g["lng"][1:]) <= metres, False).tolist()
    out, i, n = [], 0, len(lat)
    while i < n:
        end = i + 1
        if near[i]:
            end += 1
            while end < n and arrays.metres(lat[i], lng[i], lat[end], lng[end]) <= metres:
                end += 1
        if end - i > 1 and ts[end - 1] - ts[i] >= least_ms:
            known = v[i:end][~np.isnan(v[i:end])]
            if (known.mean() if len(known) else 0.0) <= most_speed:
                out.append((i, end))
                i = end
                continue
        out.append((i, i + 1))
        i += 1
    return out


def compress_stays(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, window, from_ts, to_ts, members, id, lat, lng``: windows and their middle members."""

    def fn(g: Group) -> dict:
        w = stay_windows(g, p.stay_m, p.stay_ms, p.stay_speed)
        s, e = (np.array(x) for x in zip(*w, strict=True))
        mid = s + (e - s) // 2
        return {"trip_id": g["trip_id"][s], "window": np.arange(len(w)), "from_ts": g["ts"][s], "to_ts": g["ts"][e - 1], "members": e - s, "id": g["id"][mid], "lat": g["lat"][mid], "lng": g["lng"][mid]}

    return map_groups(points, KEYS, ORDER, fn, "trip_id long, window int, from_ts long, to_ts long, members int, id long, lat double, lng double")


def stay_members(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, id, window, middle``: the window of every point, and whether it stands for the window."""

    def fn(g: Group) -> dict:
        w = np.array(stay_windows(g, p.stay_m, p.stay_ms, p.stay_speed))
        size = w[:, 1] - w[:, 0]
        middle = np.zeros(len(g["id"]), bool)
        middle[w[:, 0] + size // 2] = True
        return {"trip_id": g["trip_id"], "id": g["id"], "window": np.repeat(np.arange(len(w)), size), "middle": middle}

    return map_groups(points, KEYS, ORDER, fn, "trip_id long, id long, window int, middle boolean")


def stay_centroids(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, id, ts, lat, lng, accuracy_m``: walking stays as means on their middle member."""

    def fn(g: Group) -> dict:
        w = stay_windows(g, p.walk_stay_m, p.walk_stay_ms, p.walk_stay_speed)
        mid = np.array([s + (e - s) // 2 for s, e in w])
        mean = {c: [float(g[c][s:e].mean()) for s, e in w] for c in ("lat", "lng")}
        acc = [float(np.nanmean(g["accuracy_m"][s:e])) if (~np.isnan(g["accuracy_m"][s:e])).any() else None for s, e in w]
        return {"trip_id": g["trip_id"][mid], "id": g["id"][mid], "ts": g["ts"][mid], "members": [e - s for s, e in w], **mean, "accuracy_m": acc}

    return map_groups(points, KEYS, ORDER, fn, "trip_id long, id long, ts long, members int, lat double, lng double, accuracy_m double")

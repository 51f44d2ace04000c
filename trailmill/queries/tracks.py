"""Tracks: heat maps, measures, cleaning, motion, stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators import clean, heatmap, motion, roads, trips
from trailmill.operators.grouped import filter_groups
from trailmill.queries.scalars import gcj_sql
from trailmill.queries.sqltext import DOUBLED, EDGES, FILL, TP, W, angle, bear, clean_where, fold, hav, spd
from trailmill.scratch import materialise
from trailmill.sources.tables import derived, read, road_edges

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _points(spark, sf):
    return derived(spark, sf, "track")


def _edges(spark):
    """Finished edges as a stored table: its true size then decides which side of a join is sent."""
    return materialise(roads.finish_edges(road_edges(spark)), "edges")


def _r(*cols: str, digits: int = 3):
    return [F.round(c, digits).alias(c) for c in cols]


# --- heat maps


def _heat_sql(scope: str, grid: int, tail: str) -> str:
    dy = f"({grid} / 111320e0)"
    dx = f"({grid} / greatest(1e0, 111320e0 * cos(radians(lat))))"
    return f"""
with recursive t as (select * from {TP} where lat between -90 and 90 and lng between -180 and 180 and not (abs(lat) < 1e-9 and abs(lng) < 1e-9) and (accuracy_m is null or accuracy_m <= 150)),
s as (select *, row_number() over (partition by {scope} order by ts, id) i, lag(lat) over (partition by {scope} order by ts, id) a, lag(lng) over (partition by {scope} order by ts, id) b, lag(ts) over (partition by {scope} order by ts, id) t0 from t),
d as (select *, {hav('a', 'b', 'lat', 'lng')} m, least(300, cast(floor((ts - t0) / 1000) as bigint)) dt, cast(floor(lat / {dy}) as bigint) y, cast(floor(lng / {dx}) as bigint) x, {dx} wx from s),
g as (select {scope}, y, x, count(*) samples, count(distinct trip_id) trips, cast(coalesce(sum(case when dt > 0 and m <= 30 then dt end), 0) as bigint) stay_s,
  sum(case when t0 is null or dt <= 0 then 0e0 when m <= 30 then least(6e0, dt / 20e0) else least(2e0, dt / 120e0) end) gain, first((y + 0.5e0) * {dy} order by ts, id) clat, first((x + 0.5e0) * wx order by ts, id) clng, min(ts) first_ts from d group by {scope}, y, x),
h as (select {scope}, y, x, round(clat, 6) lat, round(clng, 6) lng, samples, trips, stay_s, cast(greatest(1, least(100, floor(samples + gain + 2 * trips + least(20e0, stay_s / 30e0) + least(50e0, 0.8e0 * samples) + 0.5e0))) as int) weight, first_ts from g)
{tail}"""


@register("heatmap_trip", _heat_sql("trip_id", 80, "select trip_id, y, x, lat, lng, samples, trips, stay_s, weight from h"))
def heatmap_trip(spark, sf):
    return heatmap.heat_cells(_points(spark, sf)).drop("first_ts")


@register("heatmap_user_scope", _heat_sql("user_id", 80, "select user_id, y, x, lat, lng, samples, trips, stay_s, weight from h"))
def heatmap_user_scope(spark, sf):
    return heatmap.heat_cells(_points(spark, sf), "user_id").drop("first_ts")


@register("heatmap_grid_clamp", _heat_sql("trip_id", 500, "select trip_id, y, x, lat, lng, samples, weight from h"))
def heatmap_grid_clamp(spark, sf):
    return heatmap.heat_cells(_points(spark, sf), grid=5000).select("trip_id", "y", "x", "lat", "lng", "samples", "weight")


@register("heatmap_top_cells", _heat_sql("user_id", 80, "select user_id, y, x, weight, rank from (select *, cast(row_number() over (partition by user_id order by weight desc, first_ts, y, x) as int) rank from h) where rank <= 20"))
def heatmap_top_cells(spark, sf):
    return heatmap.top_cells(heatmap.heat_cells(_points(spark, sf), "user_id"), "user_id", 20).select("user_id", "y", "x", "weight", "rank")


# --- measures

_STEP = f"select *, {hav(f'lag(lat) {W}', f'lag(lng) {W}', 'lat', 'lng')} s from {TP}"


@register("trip_distance", f"select trip_id, cast(floor(coalesce(sum(s), 0) + 0.5e0) as bigint) distance_m from ({_STEP}) group by trip_id")
def trip_distance(spark, sf):
    return trips.distances(_points(spark, sf))


@register("trip_bbox", f"""select *, case when span < 0.002 then 17 when span < 0.005 then 16 when span < 0.01 then 15 when span < 0.03 then 14 when span < 0.08 then 13 else 12 end zoom from
 (select trip_id, min(lat) min_lat, max(lat) max_lat, min(lng) min_lng, max(lng) max_lng, (min(lat) + max(lat)) / 2 center_lat, (min(lng) + max(lng)) / 2 center_lng, round(greatest(max(lat) - min(lat), max(lng) - min(lng)), 9) span from {TP} group by trip_id)""")
def trip_bbox(spark, sf):
    b = trips.boxes(_points(spark, sf))
    return b.withColumn("span", F.round(F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lng") - F.col("min_lng")), 9))


@register("trip_duration", f"select trip_id, cast(floor((max(ts) - min(ts)) / 1000) as bigint) duration_sec, count(*) points from {TP} group by trip_id")
def trip_duration(spark, sf):
    return _points(spark, sf).groupBy("trip_id").agg(F.floor((F.max("ts") - F.min("ts")) / 1000).cast("long").alias("duration_sec"), F.count(F.lit(1)).alias("points"))


@register("place_chunks", f"""select trip_id, k, count(*) points, round(avg(lat), 8) lat, round(avg(lng), 8) lng, min(ts) start_ts, max(ts) end_ts, cast(floor((max(ts) - min(ts)) / 1000) as bigint) duration_sec, '地点 ' || k poi_name
 from (select *, cast(floor((row_number() {W} - 1) / 10) as bigint) + 1 k, count(*) over (partition by trip_id) n from {TP}) where n >= 10 group by trip_id, k""")
def place_chunks(spark, sf):
    p = trips.places(_points(spark, sf))
    return p.withColumns({c: F.round(c, 8) for c in ("lat", "lng")})


# --- cleaning


@register("accuracy_filter", f"select id, trip_id from {TP} where {clean_where(120)}")
def accuracy_filter(spark, sf):
    return clean.accurate(_points(spark, sf), 120.0).select("id", "trip_id")


@register("fill_heading_speed", f"with t as (select * from {DOUBLED}), {FILL} select trip_id, id, round(heading_deg, 3) heading_deg, round(speed_mps, 3) speed_mps from f")
def fill_heading_speed(spark, sf):
    return clean.fill_heading_and_speed(derived(spark, sf, "doubled")).select("trip_id", "id", *_r("heading_deg", "speed_mps"))


def _fold_sql(drop: str, ends: bool = True) -> str:
    return f"with recursive t as (select * from {DOUBLED}), {fold('t', drop, ends)} select trip_id, id from k"


def _fold_query(keep):
    return lambda spark, sf: filter_groups(derived(spark, sf, "doubled"), clean.KEYS, clean.ORDER, keep).select("trip_id", "id")


register("temporal_dedup", _fold_sql("{dt01} < 1000 and {d01} < 2", False))(_fold_query(clean.keep_after_dedup))
register("jump_filter", _fold_sql("{s01} > 55 and {s12} > 55 and {d02} < greatest(20e0, 0.4e0 * ({d01} + {d12}))"))(_fold_query(clean.keep_without_jumps))
register("spike_filter_drive", _fold_sql("({d01} > 250 or {d12} > 250 or {d01} / (greatest(1, {dt01}) / 1000e0) > 35 or {d12} / (greatest(1, {dt12}) / 1000e0) > 35) and {d02} <= 250"))(_fold_query(clean.keep_without_drive_spikes))
register("spike_filter_walk", _fold_sql("({s01} > 7.5 and {s12} > 7.5 and {d02} < greatest(12e0, 0.45e0 * ({d01} + {d12}))) or (coalesce(accuracy_m, 0) > 60 and {d01} > 35 and {d12} > 35 and {d02} < 15)"))(_fold_query(clean.keep_without_walk_spikes))
register("walk_simplify", _fold_sql(f"not ({{d01}} >= 4 or {{dt01}} >= 30000 or {angle(bear('l_lat', 'l_lng', 'lat', 'lng'), bear('lat', 'lng', 'x_lat', 'x_lng'))} >= 28)"))(_fold_query(clean.keep_simplified_walk))
register("keep_moved_15m", _fold_sql("{d01} < 15", False))(_fold_query(lambda g: clean.keep_moved(g, 15.0)))
register("heatmap_clean", _fold_sql("{dt01} = 0 and {d01} < 3", False))(_fold_query(clean.keep_for_heatmap))
register("display_dedup", _fold_sql("{dt01} = 0 and {d01} < 1.5", False))(_fold_query(clean.keep_for_display))


def _clean_sql(most: int, drop: str) -> str:
    return f"""with recursive t0 as (select * from {DOUBLED} where {clean_where(most)}), {fold('t0', '{dt01} < 1000 and {d01} < 2', False, 'a')},
 t1 as (select t0.* from t0 join a using (trip_id, id)), {fold('t1', drop, True, 'b')}, t as (select t1.* from t1 join b using (trip_id, id)), {FILL}
 select trip_id, id, round(lat, 6) lat, round(lng, 6) lng from f"""


@register("general_clean", _clean_sql(200, "{s01} > 55 and {s12} > 55 and {d02} < greatest(20e0, 0.4e0 * ({d01} + {d12}))"))
def general_clean(spark, sf):
    return clean.general(derived(spark, sf, "doubled")).select("trip_id", "id", *_r("lat", "lng", digits=6))


@register("driving_clean", _clean_sql(120, "({d01} > 250 or {d12} > 250 or {d01} / (greatest(1, {dt01}) / 1000e0) > 35 or {d12} / (greatest(1, {dt12}) / 1000e0) > 35) and {d02} <= 250"))
def driving_clean(spark, sf):
    return clean.driving(derived(spark, sf, "doubled")).select("trip_id", "id", *_r("lat", "lng", digits=6))


@register("thin_uniform", f"select trip_id, id from (select *, row_number() {W} - 1 i, count(*) over (partition by trip_id) n from {TP}) where n <= 25 or i % cast(ceil(n / 25e0) as bigint) = 0 or i = n - 1")
def thin_uniform(spark, sf):
    return clean.thin(_points(spark, sf), 25).select("trip_id", "id")


@register("path_key_dedup", f"select trip_id, id from (select *, row_number() over (partition by trip_id, round(lat, 6), round(lng, 6), floor(ts / 1000) order by ts, id) k from {DOUBLED}) where k = 1")
def path_key_dedup(spark, sf):
    return clean.first_of_place_and_second(derived(spark, sf, "doubled")).select("trip_id", "id")


# --- smoothing and motion


def _smooth_sql(walking: bool) -> str:
    lag = lambda c, k: c if k == 0 else f"{'lag' if k < 0 else 'lead'}({c}, {abs(k)}) {W}"
    weight = lambda k: f"case when {lag('lat', k)} is null then 0e0 else 1e0 / (1 + {abs(k)})" + (f" / (1 + coalesce({lag('accuracy_m', k)}, 15) / 30e0)" if walking else "") + " end"
    sums = [f"({' + '.join(f'{weight(k)} * coalesce({lag(c, k)}, 0)' for k in (-2, -1, 0, 1, 2))})" for c in ("lat", "lng")]
    total = f"({' + '.join(weight(k) for k in (-2, -1, 0, 1, 2))})"
    by, plain = (f"greatest({total}, 1)", "n < 3 or i = 1 or i = n") if walking else (total, "n < 3")
    inner = f"select *, {sums[0]} / {by} la, {sums[1]} / {by} ln, row_number() {W} i, count(*) over (partition by trip_id) n from {TP}"
    return f"select trip_id, id, round(case when {plain} then lat else la end, 8) lat, round(case when {plain} then lng else ln end, 8) lng from ({inner})"


@register("smooth_r2", _smooth_sql(False))
def smooth_r2(spark, sf):
    return motion.smooth(_points(spark, sf)).select("trip_id", "id", *_r("lat", "lng", digits=8))


@register("smooth_walk", _smooth_sql(True))
def smooth_walk(spark, sf):
    return motion.smooth(_points(spark, sf), walking=True).select("trip_id", "id", *_r("lat", "lng", digits=8))


def _proj(lat: str = "lat", lng: str = "lng") -> str:
    """CTE text: distance ``pd``, offset and place of a point on an edge of the same row."""
    e = f"(cos(radians(({lat} + lat1 + lat2) / 3)) * 111320e0)"
    return f"""{e} ex, (lng2 - lng1) * {e} dx, (lat2 - lat1) * 111320e0 dy, ({lng} - lng1) * {e} px, ({lat} - lat1) * 111320e0 py"""


NEAR = f"""
ed as (select e.*, {hav('lat1', 'lng1', 'lat2', 'lng2')} length_m, {bear('lat1', 'lng1', 'lat2', 'lng2')} direction from {EDGES} e),
pairs as (select *, greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) tt from (select q.id, q.lat qlat, q.lng qlng, ed.*, {_proj('q.lat', 'q.lng')} from q join ed on q.lat between least(lat1, lat2) - 0.006 and greatest(lat1, lat2) + 0.006 and q.lng between least(lng1, lng2) - 0.006 and greatest(lng1, lng2) + 0.006) z),
near as (select *, sqrt(pow(px - tt * dx, 2) + pow(py - tt * dy, 2)) pd, sqrt(dx * dx + dy * dy) * tt off, lat1 + tt * (lat2 - lat1) p_lat, lng1 + tt * (lng2 - lng1) p_lng from pairs)"""

_F5 = "over (partition by trip_id order by ts, id rows between 2 preceding and 2 following)"
EVIDENCE = f"""
t as (select * from {TP} where {clean_where(200)}), {FILL}, q as (select id, lat, lng from f), {NEAR},
rd as (select id, min(pd) road_m from near where pd <= 60 group by id),
w as (select f.*, coalesce(road_m, 'infinity'::double) far from f left join rd using (id)),
e0 as (select trip_id, id, ts, median(speed_mps) {_F5} median_speed, greatest(0e0, max(speed_mps) {_F5}) max_speed, avg(case when far <= 18 then 1e0 else 0e0 end) {_F5} near_ratio, avg(case when far >= 30 then 1e0 else 0e0 end) {_F5} off_ratio,
  avg(case when speed_mps <= 1 then 1e0 else 0e0 end) {_F5} stay_ratio, first(lat) {_F5} fa, first(lng) {_F5} fb, first(ts) {_F5} ft, last(lat) {_F5} ta, last(lng) {_F5} tb, last(ts) {_F5} tt from w),
e1 as (select *, {spd(hav('fa', 'fb', 'ta', 'tb'), 'greatest(1, tt - ft)')} avg_speed from e0),
ev as (select trip_id, id, ts, median_speed, max_speed, near_ratio, off_ratio, stay_ratio, avg_speed,
  (case when median_speed >= 3.8 then 1.2e0 else 0e0 end) + (case when max_speed >= 6.5 then 1.4e0 else 0e0 end) + (case when avg_speed >= 4.2 then 0.8e0 else 0e0 end) + (case when near_ratio >= 0.6 then 0.8e0 else 0e0 end) + (case when near_ratio >= 0.8 and median_speed >= 2.8 then 0.8e0 else 0e0 end) drive_score,
  (case when median_speed <= 2.2 then 1.2e0 else 0e0 end) + (case when max_speed <= 4.2 then 0.5e0 else 0e0 end) + (case when off_ratio >= 0.4 then 1e0 else 0e0 end) + (case when stay_ratio >= 0.5 then 0.7e0 else 0e0 end) + (case when avg_speed <= 2 then 0.6e0 else 0e0 end) walk_score from e1)"""


def evidence_of(spark, sf):
    p = clean.fill_heading_and_speed(clean.accurate(_points(spark, sf), 200.0))
    return motion.evidence(roads.nearest_distance(p, _edges(spark)))


@register("motion_evidence", f"with {EVIDENCE} select trip_id, id, round(median_speed, 3) median_speed, round(max_speed, 3) max_speed, round(near_ratio, 3) near_ratio, round(off_ratio, 3) off_ratio, round(stay_ratio, 3) stay_ratio, round(avg_speed, 3) avg_speed from ev")
def motion_evidence(spark, sf):
    return evidence_of(spark, sf).select("trip_id", "id", *_r("median_speed", "max_speed", "near_ratio", "off_ratio", "stay_ratio", "avg_speed"))


@register("motion_scores", f"with {EVIDENCE} select trip_id, id, round(drive_score, 3) drive_score, round(walk_score, 3) walk_score from ev")
def motion_scores(spark, sf):
    return evidence_of(spark, sf).select("trip_id", "id", *_r("drive_score", "walk_score"))


_MODES = f"""
with recursive {EVIDENCE}, p as (select *, row_number() {W} i from ev),
m as (
  select trip_id, i, id, false drives from p where false
  union all select trip_id, cast(0 as bigint), cast(-1 as bigint), false from (select distinct trip_id from p)
  union all
  select p.trip_id, p.i, p.id, case when (max_speed >= 9 and near_ratio >= 0.4) or drive_score >= walk_score + 0.7e0 then true when walk_score >= drive_score + 0.4e0 then false
    when drives and near_ratio >= 0.55 and median_speed >= 2.8 then true when not drives and (median_speed <= 2.6 or off_ratio >= 0.35 or stay_ratio >= 0.45) then false else near_ratio >= 0.75 and median_speed >= 3.2 end
  from m join p on p.trip_id = m.trip_id and p.i = m.i + 1)
select trip_id, id, case when drives then 'DRIVING' else 'WALKING' end mode_raw from m where i > 0"""
_MODES = _MODES.replace("select trip_id, i, id, false drives from p where false\n  union all select trip_id, cast(0 as bigint), cast(-1 as bigint), false from (select distinct trip_id from p)", "select distinct trip_id, cast(0 as bigint) i, cast(-1 as bigint) id, false drives from p")


@register("motion_modes", _MODES)
def motion_modes(spark, sf):
    return motion.raw_modes(evidence_of(spark, sf)).select("trip_id", "id", F.when(F.col("drives"), "DRIVING").otherwise("WALKING").alias("mode_raw"))


def _pass(k: int) -> str:
    """One pass over the runs: short ones take the mode of their neighbours."""
    return f"""
a{k} as (select *, sum(new) over (partition by trip_id order by i rows between unbounded preceding and current row) run from (select *, case when drives <> lag(drives) over (partition by trip_id order by i) then 1 else 0 end new from s{k})),
b{k} as (select *, count(*) over (partition by trip_id, run) n, max(ts) over (partition by trip_id, run) - min(ts) over (partition by trip_id, run) d, max(run) over (partition by trip_id) most from a{k}),
s{k + 1} as (select trip_id, id, ts, i, case when (n < 4 or d < 45000) and most > 0 then not drives else drives end drives from b{k})"""


_SEGMENTS = _MODES[: _MODES.rindex("select trip_id, id, case when drives")] + f""", s0 as (select m.trip_id, m.id, p.ts, m.i, drives from m join p on p.trip_id = m.trip_id and p.i = m.i where m.i > 0), {', '.join(map(_pass, range(4)))}
select a3.trip_id, cast(run as int) segment, case when drives then 'DRIVING' else 'WALKING' end mode, count(*) points, min(a3.ts) from_ts, max(a3.ts) to_ts, round(avg(near_ratio) + 1e-9, 3) near_ratio, round(avg(off_ratio) + 1e-9, 3) off_ratio, round(avg(avg_speed), 3) avg_speed, round(max(max_speed), 3) max_speed
from a3 join ev on ev.trip_id = a3.trip_id and ev.id = a3.id group by a3.trip_id, run, drives"""


@register("motion_segments", _SEGMENTS)
def motion_segments(spark, sf):
    e = evidence_of(spark, sf)
    # ratios are often half-way between two rounded ones, to which a little is added
    return motion.segments(e, motion.classify(e)).withColumns({c: F.round(F.col(c) + (1e-9 if c.endswith("ratio") else 0.0), 3) for c in ("near_ratio", "off_ratio", "avg_speed", "max_speed")})


def _filled(spark, sf):
    return clean.fill_heading_and_speed(_points(spark, sf))


def _stay_sql(metres: float, ms: int, most: float) -> str:
    """Windows by recursion: from each start the end of its window is known beforehand."""
    return f"""
with recursive t as (select * from {TP}), {FILL}, p as (select *, row_number() {W} i, count(*) over (partition by trip_id) n from f),
brk as (select a.trip_id, a.i, coalesce(min(b.i), any_value(a.n) + 1) stop from p a left join p b on a.trip_id = b.trip_id and b.i > a.i and {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} > {metres} group by a.trip_id, a.i),
win as (select k.trip_id, k.i, k.stop, max(p.ts) - min(p.ts) dur, avg(p.speed_mps) v from brk k join p on p.trip_id = k.trip_id and p.i >= k.i and p.i < k.stop group by k.trip_id, k.i, k.stop),
nxt as (select trip_id, i, case when stop - i > 1 and dur >= {ms} and v <= {most} then stop else i + 1 end e from win),
r as (select trip_id, i, e, 0 win from nxt where i = 1 union all select nxt.trip_id, nxt.i, nxt.e, r.win + 1 from r join nxt on nxt.trip_id = r.trip_id and nxt.i = r.e)"""


@register("stay_windows_drive", _stay_sql(12, 20000, 1.5) + "select r.trip_id, r.win \"window\", min(p.ts) from_ts, max(p.ts) to_ts, cast(r.e - r.i as int) members, any_value(m.id) id from r join p on p.trip_id = r.trip_id and p.i >= r.i and p.i < r.e join p m on m.trip_id = r.trip_id and m.i = r.i + (r.e - r.i) // 2 group by r.trip_id, r.win, r.i, r.e")
def stay_windows_drive(spark, sf):
    return motion.compress_stays(_filled(spark, sf)).select("trip_id", "window", "from_ts", "to_ts", "members", "id")


@register("stay_centroids_walk", _stay_sql(10, 15000, 1.2) + "select r.trip_id, any_value(m.id) id, cast(r.e - r.i as int) members, round(avg(p.lat), 8) lat, round(avg(p.lng), 8) lng, round(avg(p.accuracy_m), 3) accuracy_m from r join p on p.trip_id = r.trip_id and p.i >= r.i and p.i < r.e join p m on m.trip_id = r.trip_id and m.i = r.i + (r.e - r.i) // 2 group by r.trip_id, r.win, r.i, r.e")
def stay_centroids_walk(spark, sf):
    return motion.stay_centroids(_filled(spark, sf)).select("trip_id", "id", "members", *_r("lat", "lng", digits=8), F.round("accuracy_m", 3).alias("accuracy_m"))


# --- sessions


@register("session_windows", """select user_id, session, count(*) n, min(ts) from_ts, max(ts) to_ts from (select *, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) session
 from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 2 day then 0 else 1 end new from events)) group by user_id, session""")
def session_windows(spark, sf):
    from pyspark.sql import Window

    e = read(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= 172_800_000_000, 0).otherwise(1)
    e = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


@register("to_wgs84", gcj_sql("-", TP, "raw_coord_type = 'GCJ02'", ", 'WGS84' raw_coord_type"))
def to_wgs84(spark, sf):
    return clean.to_wgs84(_points(spark, sf)).select("id", *_r("lat", "lng", digits=6), "raw_coord_type")


def _bits(c: str) -> str:
    """The bits of a double, byte by byte from the last one."""
    return " || ".join(f"substr(cast(cast({c} as bit) as varchar), {57 - 8 * i}, 8)" for i in range(8))


@register("coordinate_bytes", f"select id, {_bits('lat')} lat_bits, {_bits('lng')} lng_bits from {TP}")
def coordinate_bytes(spark, sf):
    bits = lambda c: F.concat(*(F.lpad(F.conv(F.hex(F.substring(geo.encode_double(c), i + 1, 1)), 16, 2), 8, "0") for i in range(8)))
    return _points(spark, sf).select("id", bits("lat").alias("lat_bits"), bits("lng").alias("lng_bits"))


@register("coordinate_codec", f"select id, lat, lng from {TP}")
def coordinate_codec(spark, sf):
    p = _points(spark, sf).select("id", geo.encode_double("lat").alias("a"), geo.encode_double("lng").alias("b"))
    return p.select("id", geo.decode_double("a").alias("lat"), geo.decode_double("b").alias("lng"))

"""Formulas as SQL text for the oracles, and the tables they start from."""

from __future__ import annotations

from trailmill.operators.roads import VEHICLE
from trailmill.sources.tables import derived_sql, lattice_sql

TP, DOUBLED, TRIP, PHOTO, VIDEO, PLACE, NOTE, ANCHOR, STORY, USERS, SUMMARY = (derived_sql(n) for n in ("track", "doubled", "trip", "photo", "video", "place", "note", "anchor", "story", "users", "summary"))
NODES, EDGES = lattice_sql("nodes"), lattice_sql("edges")

_KINDS = ", ".join(f"'{x}'" for x in VEHICLE)
TYPE = f"(case when trim(highway) = '' then null when lower(trim(highway)) <> 'construction' then trim(highway) when trim(construction) in ({_KINDS}) then trim(construction) end)"
#: Streets of the town with what their tags say.
TOWN_WAYS = f"""(select id, first, step, n, coalesce(name, '未命名道路') "name", {TYPE} "type", coalesce(lower(oneway) in ('yes', '1', 'true'), false) one_way, coalesce(try_cast(regexp_replace(maxspeed, '[^0-9]', '', 'g') as int), 50) max_speed,
 coalesce(try_cast(trim(layer) as int), 0) layer, coalesce(lower(bridge) <> 'no', false) bridge, coalesce(lower(tunnel) <> 'no', false) tunnel, coalesce(highway like '%!_link' escape '!', false) or coalesce(lower(junction) in ('slip_road', 'ramp'), false) ramp,
 coalesce({TYPE} in ({_KINDS}), false) and coalesce(lower(motor_vehicle), '') <> 'no' and (coalesce(lower(access), '') <> 'no' or coalesce(lower(service), '') = 'destination') drivable from {derived_sql("town_way")} w)"""
TOWN_NODES = derived_sql("town_node")
#: Pieces of the streets that cars may use, between crossings that are on the map.
TOWN_EDGES = f"""(select w.id * 1048576 + seq edge_id, w.id way_id, a.id start_node, b.id end_node, a.lat lat1, a.lng lng1, b.lat lat2, b.lng lng2, "name", "type", one_way, max_speed, layer, bridge, tunnel, ramp
 from {TOWN_WAYS} w cross join (values (0), (1), (2), (3)) s(seq) join {TOWN_NODES} a on a.id = first + seq * step join {TOWN_NODES} b on b.id = first + (seq + 1) * step where drivable and seq < n - 1)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bear(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(case when {x} < 0 then {x} + 360 else {x} end)"


def angle(a: str, b: str) -> str:
    d = f"(abs({a} - {b}) % 360)"
    return f"(case when {d} > 180 then 360 - {d} else {d} end)"


def spd(d: str, ms: str) -> str:
    return f"(case when {ms} > 0 then {d} / ({ms} / 1000e0) else 0e0 end)"


def order_by(*cols: str) -> str:
    return f"over (partition by trip_id order by {', '.join(cols or ('ts', 'id'))})"


W = order_by()

#: Fills headings and speeds of a table ``t``; gives ``f``.
FILL = f"""
n as (select *, lag(lat) {W} a0, lag(lng) {W} b0, lag(ts) {W} t0, lead(lat) {W} a1, lead(lng) {W} b1, lead(ts) {W} t1 from t),
f as (select id, user_id, trip_id, ts, lat, lng, accuracy_m, source, raw_coord_type,
  case when heading_deg >= 0 then heading_deg else coalesce(case when {hav('a0', 'b0', 'lat', 'lng')} >= 3 then {bear('a0', 'b0', 'lat', 'lng')} when {hav('lat', 'lng', 'a1', 'b1')} >= 3 then {bear('lat', 'lng', 'a1', 'b1')} end, heading_deg) end heading_deg,
  case when speed_mps >= 0 then speed_mps when t0 is not null then {hav('a0', 'b0', 'lat', 'lng')} / (greatest(1, ts - t0) / 1000e0)
    else coalesce({hav('lat', 'lng', 'a1', 'b1')} / (greatest(1, t1 - ts) / 1000e0), 0e0) end speed_mps from n)"""


def clean_where(most: int) -> str:
    return f"lat between -90 and 90 and lng between -180 and 180 and not (abs(lat) < 1e-8 and abs(lng) < 1e-8) and (accuracy_m is null or accuracy_m <= {most})"


def fold(source: str, drop: str, ends: bool = True, out: str = "k") -> str:
    """CTEs of a fold over ``source``: ``out`` has the kept rows. ``drop`` sees l* (last kept), lat.. and x* (next)."""
    d01, d12, d02 = hav("l_lat", "l_lng", "lat", "lng"), hav("lat", "lng", "x_lat", "x_lng"), hav("l_lat", "l_lng", "x_lat", "x_lng")
    cond = drop.format(d01=d01, d12=d12, d02=d02, dt01="(ts - l_ts)", dt12="(x_ts - ts)", s01=spd(d01, "(ts - l_ts)"), s12=spd(d12, "(x_ts - ts)"))
    guard = "p.i < n and n >= 3 and " if ends else ""
    return f"""
{out}_p as (select trip_id, id, ts, lat, lng, accuracy_m, row_number() {W} i, count(*) over (partition by trip_id) n, lead(lat) {W} x_lat, lead(lng) {W} x_lng, lead(ts) {W} x_ts from {source}),
{out}_r as (
  select trip_id, i, id, true keep, lat l_lat, lng l_lng, ts l_ts from {out}_p where i = 1
  union all
  select trip_id, i, id, keep, case when keep then lat else l_lat end, case when keep then lng else l_lng end, case when keep then ts else l_ts end
  from (select p.*, l_lat, l_lng, l_ts, not ({guard}({cond})) keep from {out}_r r join {out}_p p on p.trip_id = r.trip_id and p.i = r.i + 1) s),
{out} as (select trip_id, id from {out}_r where keep)"""

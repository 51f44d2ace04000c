"""Journal tables over the driver's Parquet tables: events become tracks, orders become trips, order
lines become photos, videos and places. The derivations are SQL that Spark and DuckDB read alike, so
an oracle starts from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.scratch import materialise

#: Positions wander around Wuhan, ten seconds apart, thirty steps on foot and thirty by car; some rows
#: repeat after 200 ms, some jump away, some have a speed or a wrong heading.
TRACK = """
select id, user_id, trip_id, ts, lat, lng, accuracy_m, speed_mps, heading_deg, source, raw_coord_type from (
  select event_id id, user_id, user_id * 1000 + cast(floor((seq - 1) / 60) as bigint) trip_id, 1704067200000 + seq * 10000 ts,
    30.59e0 + cy * 0.00001e0 + case when event_id % 97 = 0 then 0.01e0 else 0e0 end lat, 114.30e0 + cx * 0.00001e0 lng,
    cast(5 + (event_id * 31) % 200 as double) accuracy_m, case when event_id % 7 = 0 then cast(1 + event_id % 9 as double) end speed_mps,
    case when event_id % 11 = 0 then -1e0 when event_id % 13 = 0 then cast(event_id % 360 as double) end heading_deg, event_type source,
    case when event_id % 5 = 0 then 'GCJ02' else 'WGS84' end raw_coord_type
  from (select event_id, user_id, event_type, seq,
    sum(((event_id * 7919) % 41 - 20) * (case when cast(floor(seq / 30) as bigint) % 2 = 1 then 8 else 1 end)) over (partition by user_id order by seq rows between unbounded preceding and current row) cy,
    sum(((event_id * 104729) % 43 - 21) * (case when cast(floor(seq / 30) as bigint) % 2 = 1 then 8 else 1 end)) over (partition by user_id order by seq rows between unbounded preceding and current row) cx
    from (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) seq from {events}) e) w) t
"""
DOUBLED = f"""
select * from ({TRACK}) a union all
select id + 10000000 id, user_id, trip_id, ts + 200 ts, lat, lng, accuracy_m, speed_mps, heading_deg, source, raw_coord_type from ({TRACK}) b where id % 50 = 0
"""
TRIP = """
select o_orderkey id, o_custkey user_id, o_orderpriority || ' trip ' || cast(o_orderkey as varchar(20)) title,
  case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'FINISHED' else 'PAUSED' end status,
  case o_orderkey % 3 when 0 then 'PUBLIC' when 1 then 'FRIENDS' else 'PRIVATE' end privacy_mode,
  cast(floor(o_totalprice) as bigint) distance_m, cast(60 * (o_orderkey % 600) as bigint) duration_sec, o_orderdate start_time,
  case when o_orderstatus = 'F' then o_orderdate + interval '5' hour end end_time, cast(o_orderkey % 4 as int) photo_count, cast(o_orderkey % 3 as int) video_count
from {orders}
"""
_MEDIA = """
select l_orderkey * 100 + ln id, o_custkey user_id, l_orderkey trip_id, 'obj/' || cast(l_orderkey as varchar(20)) || '/' || cast(ln as varchar(20)) object_key,
  'thumb/' || cast(l_orderkey as varchar(20)) || '/' || cast(ln as varchar(20)) thumbnail_object_key, 'h' || cast(l_partkey % 500 as varchar(20)) file_hash,
  case when l_partkey % 10 <> 0 then l_shipdate end shot_time_exif, case when l_partkey % 2 = 0 then 'caption ' || cast(l_partkey as varchar(20)) end user_caption,
  case when l_returnflag = 'R' then 'READY' when l_returnflag = 'A' then 'FAILED' else 'PENDING' end processing_status,
  case l_linestatus when 'O' then 'PUBLIC' else 'PRIVATE' end privacy_mode, l_partkey % 5 = 0 is_cover, l_shipdate + interval '1' day created_at
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ln from {lineitem} join {orders} on l_orderkey = o_orderkey) li
"""
PHOTO = f"select * from ({_MEDIA}) m where id % 2 = 1"
VIDEO = f"select * from ({_MEDIA}) m where id % 2 = 0"
PLACE = """
select l_orderkey * 100 + ln id, o_custkey user_id, l_orderkey trip_id, 30e0 + (l_partkey % 100) * 0.01e0 lat, 114e0 + (l_suppkey % 100) * 0.01e0 lng,
  l_shipdate start_time, cast(60 * l_quantity as bigint) duration_sec, 'city' || cast(l_suppkey % 7 as varchar(20)) city, 'district' || cast(l_suppkey % 13 as varchar(20)) district,
  case when l_partkey % 11 <> 0 then 'spot ' || cast(l_partkey % 50 as varchar(20)) end poi_name,
  case when l_partkey % 3 = 0 then l_orderkey * 100 + 1 end photo_cover_id, case when l_partkey % 2 = 0 then l_orderkey * 100 + 2 end video_cover_id,
  cast(l_partkey % 4 as int) photo_count, cast(l_partkey % 3 as int) video_count, case l_returnflag when 'A' then 'PUBLIC' when 'R' then 'FRIENDS' else 'PRIVATE' end privacy_level,
  ' tag' || cast(l_partkey % 5 as varchar(20)) || ', , tag' || cast(l_suppkey % 5 as varchar(20)) user_tags, l_shipdate + interval '2' day generated_at
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ln from {lineitem} join {orders} on l_orderkey = o_orderkey) li where ln <= 3
"""
NOTE = """
select l_orderkey * 100 + ln id, o_custkey user_id, l_orderkey trip_id, case when l_partkey % 2 = 0 then l_partkey * 1000 end anchor_ts, case when l_suppkey % 2 = 0 then 30e0 end lat,
  case when l_partkey % 6 <> 0 then 'note ' || cast(l_partkey % 20 as varchar(20)) end title, 'content ' || cast(l_suppkey as varchar(20)) content,
  case l_linestatus when 'O' then 'PUBLIC' else 'PRIVATE' end privacy_mode, l_shipdate + interval '3' day created_at
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ln from {lineitem} join {orders} on l_orderkey = o_orderkey) li where ln = 4
"""
#: What photos, videos and notes take from their lines, for those who need them together.
LINE = """
select l_orderkey trip_id, ln, l_orderkey * 100 + ln id, case when l_partkey % 10 <> 0 then l_shipdate end shot_time_exif, l_shipdate + interval '3' day noted_at
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ln from {lineitem} join {orders} on l_orderkey = o_orderkey) li
"""
ANCHOR = """
select l_orderkey * 100 + ln id, o_custkey user_id, l_orderkey trip_id, case when ln % 2 = 1 then l_orderkey * 100 + ln end photo_id,
  case when ln % 2 = 0 then l_orderkey * 100 + ln end video_id, l_partkey * 1000 matched_ts,
  case l_partkey % 4 when 0 then 'EXIF_DIRECT' when 1 then 'TIME_NEAREST' when 2 then 'INTERPOLATE' else 'MANUAL_PICK' end match_method,
  l_discount * 10 confidence, l_returnflag = 'R' manual_override
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ln from {lineitem} join {orders} on l_orderkey = o_orderkey) li
"""
STORY = """
select l_orderkey * 100 + ln id, o_custkey user_id, l_orderkey trip_id,
  case ln % 4 when 0 then 'TEXT' when 1 then 'PHOTO' when 2 then 'VIDEO' else 'PLACE_SUMMARY' end block_type,
  case ln % 4 when 0 then 'TRIP_NOTE' when 1 then 'photo' when 2 then 'VIDEO' else 'place_summary' end ref_type, l_orderkey * 100 + ln ref_id,
  l_shipdate sort_time, cast(ln as int) sort_index, 'block ' || cast(ln as varchar(20)) title, case when l_partkey % 7 = 0 then 'cover/' || cast(l_partkey as varchar(20)) end cover_object_key, l_returnflag = 'R' is_hidden
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ln from {lineitem} join {orders} on l_orderkey = o_orderkey) li
"""
USER = """
select c_custkey id, c_name open_id, case when c_custkey % 3 = 0 then 'u' || cast(c_custkey as varchar(20)) end union_id, c_mktsegment || ' ' || cast(c_custkey as varchar(20)) nickname,
  case c_nationkey % 3 when 0 then 'PUBLIC' when 1 then 'FRIENDS' else 'PRIVATE' end default_privacy_mode from {customer}
"""
SUMMARY = """
select o_orderkey id, o_custkey user_id, o_orderkey trip_id, 'overview ' || cast(o_orderkey as varchar(20)) overview, 'first' || chr(10) || chr(10) || 'second ' || o_orderpriority highlights,
  'm' || cast(o_orderkey % 3 as varchar(20)) model_name, 'v' || cast(o_orderkey % 2 as varchar(20)) version, o_orderdate generated_at from {orders} where o_orderkey % 2 = 0
"""

#: A town whose crossings are the orders, on a grid as wide as high, two thousandths of a degree apart.
_WIDTH = "(select cast(ceil(sqrt(max(o_orderkey) + 1)) as bigint) w from {orders}) side"
TOWN_NODE = f"""
select o_orderkey id, 30.59e0 + (floor(o_orderkey / w) - floor(w / 2)) * 0.002e0 + ((o_orderkey * 37) % 11 - 5) * 0.00004e0 lat,
  114.30e0 + (o_orderkey % w - floor(w / 2)) * 0.002e0 + ((o_orderkey * 53) % 13 - 6) * 0.00003e0 lng
from {{orders}} cross join {_WIDTH}
"""
#: Its streets: from each fourth crossing one of five crossings eastwards, from each eighth one of four
#: northwards, some beyond the edge of the map. Tags are columns here; every case that the rules tell apart occurs.
TOWN_WAY = f"""
select id, first, step, n,
  case t when 0 then 'primary' when 1 then 'secondary' when 2 then 'residential' when 3 then 'tertiary' when 4 then 'service' when 5 then 'trunk' when 6 then 'motorway' when 7 then 'unclassified'
    when 8 then 'living_street' when 9 then 'trunk_link' when 10 then ' trunk_link ' when 11 then 'construction' when 12 then 'Construction' when 13 then 'construction' when 14 then 'footway' when 15 then ''
    when 17 then 'track' when 18 then 'service' when 19 then 'service' when 20 then 'tertiary' when 21 then 'residential' end highway,
  case t when 11 then 'secondary' when 12 then 'footway' when 13 then ' living_street' end construction, case t when 18 then 'no' when 19 then 'NO' end access, case t when 19 then 'destination' end service,
  case t when 20 then 'no' when 21 then 'yes' end motor_vehicle, case when id % 5 = 0 then 'yes' when id % 35 = 1 then '1' when id % 35 = 2 then 'True' when id % 35 = 3 then '-1' end oneway,
  case when id % 3 <> 0 then 'R' || cast(id as varchar(20)) end name, case id % 4 when 0 then '60 km/h' when 1 then '120' when 2 then 'none' end maxspeed,
  case id % 13 when 0 then '1' when 1 then ' 2 ' when 2 then 'x' when 3 then '-1' end layer, case id % 17 when 0 then 'yes' when 1 then 'no' when 2 then 'viaduct' end bridge,
  case id % 19 when 0 then 'yes' when 1 then 'NO' end tunnel, case id % 23 when 0 then 'slip_road' when 1 then 'roundabout' when 2 then 'Ramp' end junction
from (
  select o_orderkey id, o_orderkey first, 1 step, 5 n, (floor(o_orderkey / 4) * 7) % 22 t from {{orders}} cross join {_WIDTH} where o_orderkey % 4 = 0 and o_orderkey % w < w - 4
  union all
  select o_orderkey, o_orderkey, w, 4, (floor(o_orderkey / 8) * 5) % 22 from {{orders}} cross join {_WIDTH} where o_orderkey % 8 = 1) streets
"""
#: The tags that streets have.
TAGS = ("highway", "construction", "access", "service", "motor_vehicle", "oneway", "name", "maxspeed", "layer", "bridge", "tunnel", "junction")

DERIVED = {"track": TRACK, "doubled": DOUBLED, "trip": TRIP, "photo": PHOTO, "video": VIDEO, "place": PLACE, "note": NOTE, "line": LINE, "anchor": ANCHOR, "story": STORY, "users": USER, "summary": SUMMARY, "town_node": TOWN_NODE, "town_way": TOWN_WAY}
_INPUTS = ("events", "orders", "lineitem", "customer")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the journal's tables."""
    text = DERIVED[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in _INPUTS if f"{{{t}}}" in text})


def town_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, node_ids, tags`` of the streets of the town, written once: what reads tags would repeat how they are derived."""
    w = derived(spark, sf_dir, "town_way")
    tags = F.map_filter(F.create_map(*(x for t in TAGS for x in (F.lit(t), F.col(t)))), lambda _, v: v.isNotNull())
    nodes = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("first") + i * F.col("step"))
    return materialise(w.select("id", nodes.alias("node_ids"), tags.alias("tags")), "ways")


def derived_sql(name: str) -> str:
    """The same rows as a subquery for DuckDB."""
    text = DERIVED[name]
    for t in _INPUTS:
        text = text.replace(f"{{{t}}}", t)
    return f"({text})"


#: Types that the edges of the test lattice take in turn.
LATTICE_TYPES = ("motorway", "trunk", "primary", "secondary", "residential", "service", "primary_link")

NODES = "select (i + 10) * 21 + (j + 10) + 1 node_id, 30.59e0 + i * 0.002e0 lat, 114.30e0 + j * 0.002e0 lng, i, j from ({i}) a cross join ({j}) b"
EDGES = """
select edge_id, way_id, start_node, end_node, lat1, lng1, lat2, lng2, case when edge_id % 10 = 3 then '未命名道路' else 'R' || cast(way_id as varchar(20)) end name,
  case edge_id % 7 {types} end type, edge_id % 5 = 0 one_way, 50 max_speed, case when edge_id % 11 = 0 then 1 else 0 end layer, edge_id % 11 = 0 bridge, false tunnel, edge_id % 7 = 6 ramp
from (
  select a.node_id edge_id, cast(a.i + 100 as bigint) way_id, a.node_id start_node, b.node_id end_node, a.lat lat1, a.lng lng1, b.lat lat2, b.lng lng2 from ({n}) a join ({n}) b on a.i = b.i and a.j + 1 = b.j
  union all
  select a.node_id + 1000, cast(a.j + 200 as bigint), a.node_id, b.node_id, a.lat, a.lng, b.lat, b.lng from ({n}) a join ({n}) b on a.i + 1 = b.i and a.j = b.j) e
"""


def _lattice(text: str, ranges: tuple[str, str]) -> str:
    nodes = NODES.replace("{i}", ranges[0]).replace("{j}", ranges[1])
    types = " ".join(f"when {k} then '{t}'" for k, t in enumerate(LATTICE_TYPES))
    return text.replace("{n}", nodes).replace("{types}", types)


_SPARK_RANGES = ("select cast(id as int) - 10 i from range(21)", "select cast(id as int) - 10 j from range(21)")
_DUCK_RANGES = ("select cast(range as int) - 10 i from range(21)", "select cast(range as int) - 10 j from range(21)")


def road_nodes(spark: SparkSession) -> DataFrame:
    """The 441 nodes of the test lattice."""
    return spark.sql(_lattice("{n}", _SPARK_RANGES)).select("node_id", "lat", "lng")


def road_edges(spark: SparkSession) -> DataFrame:
    """Its 840 edges, without degree and length."""
    return spark.sql(_lattice(EDGES, _SPARK_RANGES))


def lattice_sql(what: str) -> str:
    return f"({_lattice({'nodes': '{n}', 'edges': EDGES}[what], _DUCK_RANGES)})"

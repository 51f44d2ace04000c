"""Ingest, deletion, replay, suggestions, story blocks, summaries and the detail of a trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators import clean, ingest, roads, trips
from trailmill.operators import relational as rel
from trailmill.plans import trip_map
from trailmill.queries.sqltext import ANCHOR, EDGES, NOTE, PHOTO, PLACE, STORY, SUMMARY, TOWN_EDGES, TP, TRIP, VIDEO
from trailmill.scratch import materialise, scratch_root
from trailmill.sources.stored import Journal
from trailmill.sources.tables import derived, read, road_edges, town_ways

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


#: Points as clients send them, of which some lack a value or have text for a number.
_SENT = """
select event_id id, event_id % 7000 trip_id, '{{"ts": ' || case when event_id % 11 = 0 then 'null' when event_id % 13 = 0 then '"soon"' else cast(1704067200000 + event_id * 1000 as varchar(20)) end
  || ', "lat": ' || case event_id % 7 when 0 then '"30.5"' when 1 then '"north"' when 2 then 'null' else '30.25' end || case when event_id % 17 = 0 then '' else ', "lng": " 114.5 "' end
  || ', "accuracyM": ' || case when event_id % 3 = 0 then '"12.5"' else '8' end || case when event_id % 5 = 0 then ', "speedMps": "fast"' else ', "speedMps": 1.5' end || '}}' body from {events}
"""
_SENT_SQL = _SENT.replace("{events}", "events").replace("{{", "{").replace("}}", "}")
_J = "trim(json_extract_string(body, '$.{}'))"


@register("batch_ingest", f"""select t.id trip_id, user_id, try_cast({_J.format('ts')} as bigint) ts, try_cast({_J.format('lat')} as double) lat, try_cast({_J.format('lng')} as double) lng, try_cast({_J.format('accuracyM')} as float) accuracy_m, try_cast({_J.format('speedMps')} as float) speed_mps, 'WX_FG' source, 'WGS84' raw_coord_type
 from ({_SENT_SQL}) s join {TRIP} t on t.id = s.trip_id where try_cast({_J.format('ts')} as bigint) is not null and try_cast({_J.format('lat')} as double) is not null and try_cast({_J.format('lng')} as double) is not null""")
def batch_ingest(spark, sf):
    p = ingest.coerce_points(spark.sql(_SENT, events=read(spark, sf, "events")), derived(spark, sf, "trip"))
    return p.select("trip_id", "user_id", "ts", geo.decode_double("lat_enc").alias("lat"), geo.decode_double("lng_enc").alias("lng"), "accuracy_m", "speed_mps", "source", "raw_coord_type")


@register("ingest_answer", f"""select s.trip_id, count(*) sent, count(*) filter (t.id is not null and try_cast({_J.format('ts')} as bigint) is not null and try_cast({_J.format('lat')} as double) is not null and try_cast({_J.format('lng')} as double) is not null) accepted
 from ({_SENT_SQL}) s left join {TRIP} t on t.id = s.trip_id group by s.trip_id""")
def ingest_answer(spark, sf):
    sent = spark.sql(_SENT, events=read(spark, sf, "events"))
    return ingest.accepted(sent, ingest.coerce_points(sent, derived(spark, sf, "trip")))


_GONE = f"(select id from {TRIP} where user_id % 9 = 1)"
_CHILDREN = {"track": TP, "photo": PHOTO, "video": VIDEO, "anchor": ANCHOR, "place": PLACE, "note": NOTE, "story": STORY, "summary": SUMMARY, "box": f"(select trip_id, trip_id id from {TP} group by trip_id)"}


@register("cascade_ten", " union all ".join([*(f"select '{n}' child, count(*) n, cast(sum(id) as bigint) ids from {s} where trip_id not in {_GONE}" for n, s in _CHILDREN.items()), f"select 'trip', count(*), cast(sum(id) as bigint) from {TRIP} where id not in {_GONE}"]))
def cascade_ten(spark, sf):
    t = derived(spark, sf, "trip")
    tables = {n: derived(spark, sf, n) for n in _CHILDREN if n != "box"}
    tables["box"] = trips.boxes(tables["track"]).withColumn("id", F.col("trip_id"))
    left = rel.delete_trips(tables | {"trip": t}, t.filter("user_id % 9 = 1"))
    parts = [df.agg(F.lit(n).alias("child"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")) for n, df in left.items()]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole


@register("replay_points", f"""select trip_id, row_number() over (partition by trip_id order by time_ms, kind, id) place, kind, id, time_ms from (select trip_id, 'POINT' kind, id, ts time_ms from {TP}
 union all select trip_id, 'PHOTO', id, epoch_ms(shot_time_exif) from {PHOTO} union all select trip_id, 'VIDEO', id, epoch_ms(shot_time_exif) from {VIDEO}) where time_ms is not null""")
def replay_points(spark, sf):
    return rel.replay(*(derived(spark, sf, n) for n in ("track", "photo", "video")))


@register("highway_top", f"select cast(row_number() over (order by n desc, type) as int) rank, type, n from (select type, count(*) n from {TOWN_EDGES} group by type) order by rank limit 12")
def highway_top(spark, sf):
    return roads.histogram(roads.whole_network(derived(spark, sf, "town_node"), town_ways(spark, sf)))


_TOLD = "select id trip_id, case id % 3 when 0 then 'short' || chr(10) || '  建议早些出发避开高峰 ' || cast(id as varchar(20)) || '  ' || chr(10) || '  ' when 1 then 'short' end answer from {trip}"


@register("trip_suggestions", f"""select t.id, coalesce(string_split(p.name, ' ')[1], '未知目的地') destination, array_to_string(case when len(l) > 0 then l else ['{"', '".join(trips.SUGGESTIONS)}'] end, '|') suggestions from (select id, list_filter(list_transform(string_split(coalesce(answer, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) > 5) l
 from {TRIP} left join ({_TOLD.replace('{trip}', TRIP)}) a on a.trip_id = id) t left join (select trip_id, arg_min(poi_name, id) as name from {PLACE} where poi_name is not null group by trip_id) p on p.trip_id = t.id""")
def trip_suggestions(spark, sf):
    t = derived(spark, sf, "trip")
    s = trips.suggestions(t, derived(spark, sf, "place"), spark.sql(_TOLD, trip=t))
    return s.withColumn("suggestions", F.array_join("suggestions", "|"))


_ASKED = """
select id, case id % 9 when 0 then 'TEXT' when 1 then 'PLACE_SUMMARY' when 2 then 'PHOTO' when 3 then 'VIDEO' when 4 then 'PHOTO_TEXT' when 5 then 'VIDEO_TEXT' when 6 then 'MIXED' when 7 then 'AI_SUMMARY' else 'ROUTE' end block_type,
  case id % 5 when 0 then 'answer ' || cast(id as varchar(20)) when 1 then '' end answer, case when id % 2 = 0 then 'content' end content, case when id % 4 < 2 then title end place_name from {story}
"""
_TITLE = " ".join(f"when '{k}' then '{v[0]}'" for k, v in trips.BLOCKS.items())
_BODY = " ".join(f"when '{k}' then '{v[1]}'" for k, v in trips.BLOCKS.items() if v[1])


@register("story_block_defaults", f"""select id, block_type, case block_type {_TITLE} else '其他记录' end title, case when coalesce(answer, '') <> '' then answer else case block_type when 'TEXT' then coalesce(content, '') when 'PLACE_SUMMARY' then '在' || coalesce(place_name, '未知地点') || '的美好时光' {_BODY} else '这是一条其他类型的记录' end end "text"
 from ({_ASKED.replace('{story}', STORY)})""")
def story_block_defaults(spark, sf):
    return trips.story_blocks(spark.sql(_ASKED, story=derived(spark, sf, "story"))).select("id", "block_type", "title", "text")


@register("summary_upsert", f"""select trip_id, overview, highlights, model_name from {SUMMARY} where trip_id not in (select id from {TRIP} where id % 5 = 0)
 union all select id, 'new ' || id, 'one' || chr(10) || 'two ' || id, 'AI Travel Assistant' from {TRIP} where id % 5 = 0""")
def summary_upsert(spark, sf):
    text = F.col("id").cast("string")
    new = derived(spark, sf, "trip").filter("id % 5 = 0").select(F.col("id").alias("trip_id"), F.concat(F.lit("new "), text).alias("overview"), F.array(F.lit("one"), F.concat(F.lit("two "), text)).alias("highlights"))
    return trips.replace_summaries(derived(spark, sf, "summary"), new).select("trip_id", "overview", "highlights", "model_name")


@register("walking_clean")
def walking_clean(spark, sf):
    w = clean.walking(derived(spark, sf, "doubled"))
    return w.select("trip_id", "id", "ts", *(F.round(c, 8).alias(c) for c in ("lat", "lng")), *(F.round(c, 3).alias(c) for c in ("accuracy_m", "heading_deg", "speed_mps")))


@register("trip_detail")
def trip_detail(spark, sf):
    t = derived(spark, sf, "trip")
    d = trip_map.trip_detail(t, derived(spark, sf, "track"), materialise(roads.finish_edges(road_edges(spark)), "edges"), *(derived(spark, sf, n) for n in ("place", "story", "summary")))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return d.select("id", "title", "place_count", "overview", size("places").alias("places"), size("blocks").alias("blocks"), F.col("map.zoom").alias("zoom"), F.col("map.matched.distance_m").alias("matched_m"), size("map.markers").alias("markers"))


_RETOLD = "select id, user_id, id trip_id, 'told ' || title overview, cast(null as varchar(20)) highlights, 'm9' model_name, 'v9' version, start_time generated_at from {trip} where status = 'ACTIVE'"


@register("stored_journal", f"""with gone as (select id from {TRIP} where status = 'PAUSED'), told as ({_RETOLD.format(trip=TRIP)}),
 s as (select * from {SUMMARY} where trip_id not in (select trip_id from told) union all select * from told)
 select 'trip' "table", id, title told from {TRIP} where id not in (select id from gone) union all select 'photo', id, object_key from {PHOTO} where trip_id not in (select id from gone)
 union all select 'summary', trip_id, overview || ' ' || version from s where trip_id not in (select id from gone)""")
def stored_journal(spark, sf):
    """Stored tables after the summaries of all active trips were told anew and all paused trips deleted."""
    t = {n: derived(spark, sf, n) for n in ("trip", "photo", "summary")}
    told = spark.sql(_RETOLD.replace("{trip}", "{trips}"), trips=t["trip"])
    j = Journal.open(spark, f"{scratch_root(spark)}/journal-{uuid.uuid4().hex}").create(t).upsert("summary", told, "trip_id")
    j = j.delete_trips(t["trip"].filter("status = 'PAUSED'"))
    part = lambda n, i, what: j.read(n).select(F.lit(n).alias("table"), F.col(i).alias("id"), what.alias("told"))
    return part("trip", "id", F.col("title")).unionByName(part("photo", "id", F.col("object_key"))).unionByName(part("summary", "trip_id", F.concat("overview", F.lit(" "), "version")))

"""Trips: their measures, places, statistics, states and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geo, text
from trailmill.operators.clean import along

CHUNK = 10


def distances(points: DataFrame) -> DataFrame:
    """``trip_id, distance_m``: sum of the steps, rounded half up."""
    step = geo.haversine(F.lag("lat").over(along()), F.lag("lng").over(along()), "lat", "lng")
    p = points.filter(geo.valid("lat", "lng")).withColumn("_s", step)
    return p.groupBy("trip_id").agg(F.floor(F.coalesce(F.sum("_s"), F.lit(0.0)) + 0.5).cast("long").alias("distance_m"))


def nearest_on_line(points: DataFrame, start_m: float) -> DataFrame:
    """``trip_id, distance, offset, cut``: the mean position of a trip on its own line, for trips of two points or more. Metres
    from it to the nearest of its projections on the segments, the first of equals; metres along the line to there; and how
    many points the line has from ``start_m`` to there, both cut ends among them.

    The same as ``geo.polyline_projection`` and ``geo.slice_polyline`` of the lines, by windows over one sort of the points: those
    walk arrays outside of compiled code, and work out the lengths so far again in every place that names them.
    """
    whole = along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.select("trip_id", "ts", "id", "lat", "lng", *(F.lead(c).over(along()).alias(f"_{c}1") for c in ("lat", "lng")), *(F.avg(c).over(whole).alias(f"_q{c}") for c in ("lat", "lng")))
    east = F.cos(F.radians((F.col("_qlat") + F.col("lat") + F.col("_lat1")) / 3.0)) * geo.DEGREE_M
    p = p.select(
        "trip_id", "ts", "id", geo.haversine("lat", "lng", "_lat1", "_lng1").alias("_len"), geo.haversine("_qlat", "_qlng", "lat", "lng").alias("_h"),
        ((F.col("_lng1") - F.col("lng")) * east).alias("_dx"), ((F.col("_lat1") - F.col("lat")) * geo.DEGREE_M).alias("_dy"),
        ((F.col("_qlng") - F.col("lng")) * east).alias("_px"), ((F.col("_qlat") - F.col("lat")) * geo.DEGREE_M).alias("_py"),
    )
    p = p.withColumn("_run", F.coalesce(F.sum("_len").over(along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    dx, dy, px, py, run = map(F.col, ("_dx", "_dy", "_px", "_py", "_run"))
    size = dx * dx + dy * dy
    t = F.when(size > 0, geo.clamp((px * dx + py * dy) / size, 0.0, 1.0)).otherwise(0.0)
    off = F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
    here = F.struct(F.when(size > 0, off).otherwise(F.col("_h")).alias("distance"), "ts", "id", (run + F.sqrt(size) * t).alias("offset"))
    p = p.select("trip_id", "ts", "id", "_run", F.when(size.isNotNull(), here).alias("_here"))
    p = p.select("trip_id", "_run", F.min("_here").over(whole).alias("_best"), F.max("_run").over(whole).alias("_whole")).filter(F.col("_best").isNotNull())
    inside = (run > geo.clamp(start_m, 0.0, F.col("_whole"))) & (run < geo.clamp(F.col("_best.offset"), 0.0, F.col("_whole")))
    g = p.groupBy("trip_id").agg(F.first("_best").alias("b"), F.count_if(inside).alias("n"))
    return g.select("trip_id", F.col("b.distance").alias("distance"), F.col("b.offset").alias("offset"), (F.col("n") + 2).cast("int").alias("cut"))


def boxes(points: DataFrame) -> DataFrame:
    """``trip_id, min_lat, max_lat, min_lng, max_lng, center_lat, center_lng, zoom``. The span that gives the zoom counts
    to nine digits: that of two coordinates of a few digits would fall below a limit by the error of a difference."""
    b = points.filter(geo.valid("lat", "lng")).groupBy("trip_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))
    span = F.round(F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lng") - F.col("min_lng")), 9)
    zoom = F.when(span < 0.002, 17).when(span < 0.005, 16).when(span < 0.01, 15).when(span < 0.03, 14).when(span < 0.08, 13).otherwise(12)
    return b.withColumns({"center_lat": (F.col("min_lat") + F.col("max_lat")) / 2, "center_lng": (F.col("min_lng") + F.col("max_lng")) / 2, "zoom": zoom})


def places(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """``trip_id, k, points, lat, lng, start_ts, end_ts, duration_sec, poi_name``: means of every ``size`` points in
    order, for trips that have so many."""
    p = points.withColumn("_i", F.row_number().over(along())).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trip_id"))).filter(F.col("_n") >= size)
    g = p.groupBy("trip_id", (F.floor((F.col("_i") - 1) / size) + 1).cast("long").alias("k"))
    g = g.agg(F.count(F.lit(1)).alias("points"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return g.withColumn("duration_sec", F.floor((F.col("end_ts") - F.col("start_ts")) / 1000).cast("long")).withColumn("poi_name", F.concat(F.lit("地点 "), F.col("k").cast("string")))


def statistics(trips: DataFrame, **children: DataFrame) -> DataFrame:
    """``id`` and for every child table ``<name>_count``, 0 where there are none: counted before the join."""
    out = trips.select("id", "distance_m", "duration_sec")
    for name, child in children.items():
        n = child.groupBy("trip_id").agg(F.count(F.lit(1)).alias(f"{name}_count")).withColumnRenamed("trip_id", "id")
        out = out.join(n, "id", "left").fillna(0, [f"{name}_count"])
    return out


def user_totals(trips: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}")
    return trips.groupBy("user_id").agg(F.count(F.lit(1)).alias("trips"), zero("distance_m"), zero("duration_sec"), zero("photo_count"), zero("video_count"))


def travel_mode(distance: Column, seconds: Column) -> Column:
    """By mean speed; a trip without duration counts as fast."""
    v = F.when(seconds > 0, distance / seconds)
    return F.when(distance.isNull() | seconds.isNull(), None).when(v < 1.5, "步行为主").when(v < 5, "自行车/电动车").otherwise("公共交通/驾车")


def analysis(trips: DataFrame, place: DataFrame) -> DataFrame:
    """``id, place_count, average_stay, longest_place, travel_mode``; of equal stays the smallest place id."""
    s = place.groupBy(F.col("trip_id").alias("id")).agg(F.count(F.lit(1)).alias("place_count"), F.sum("duration_sec").alias("_s"), F.max_by("poi_name", F.struct("duration_sec", -F.col("id"))).alias("longest_place"))
    t = trips.join(s, "id", "left")
    return t.select("id", F.coalesce("place_count", F.lit(0)).alias("place_count"), F.floor(F.col("_s") / F.col("place_count")).cast("long").alias("average_stay"), "longest_place", travel_mode(F.col("distance_m"), F.col("duration_sec")).alias("travel_mode"))


def settle(trips: DataFrame, points: DataFrame, photo: DataFrame, video: DataFrame) -> DataFrame:
    """``id, distance_m, duration_sec, min_lat, max_lat, min_lng, max_lng, photo_count, video_count, place_count, status``: all
    trips at once, from tables that are summed before they are joined."""
    d, b = distances(points), boxes(points).select("trip_id", *(F.col(c).cast("float").alias(c) for c in ("min_lat", "max_lat", "min_lng", "max_lng")))
    k = places(points).groupBy("trip_id").agg(F.count(F.lit(1)).alias("place_count"))
    t = points.groupBy("trip_id").agg(F.floor((F.max("ts") - F.min("ts")) / 1000).cast("long").alias("duration_sec"))
    out = trips.select(F.col("id").alias("trip_id"))
    for part in (d, t, b, photo.groupBy("trip_id").agg(F.count(F.lit(1)).alias("photo_count")), video.groupBy("trip_id").agg(F.count(F.lit(1)).alias("video_count")), k):
        out = out.join(part, "trip_id", "left")
    return out.fillna(0, ["distance_m", "duration_sec", "photo_count", "video_count", "place_count"]).withColumn("status", F.lit("FINISHED")).withColumnRenamed("trip_id", "id")


#: Which state may follow which.
MOVES = {("ACTIVE", "PAUSED"), ("PAUSED", "ACTIVE"), ("ACTIVE", "PROCESSING"), ("PAUSED", "PROCESSING"), ("PROCESSING", "FINISHED")}


def bad_moves(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of a log of states (``status``) that may not follow the one before: ``before`` and ``status``."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    ok = F.concat_ws(">", "before", "status").isin(*(">".join(m) for m in sorted(MOVES)))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("status")) & ~ok)


def create(rows: DataFrame) -> DataFrame:
    """New trips with their defaults, from ``user_id, title, timezone, privacy_mode, start_time``."""
    blank = lambda c, v: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", v).otherwise(F.col(c))
    return rows.select("user_id", blank("title", "未命名行程").alias("title"), blank("timezone", text.ZONE).alias("timezone"), text.enum_or_default(F.col("privacy_mode"), ("PUBLIC", "FRIENDS", "PRIVATE"), "PUBLIC").alias("privacy_mode"),
                       F.lit("ACTIVE").alias("status"), "start_time", *(F.lit(0).cast("long").alias(c) for c in ("distance_m", "duration_sec")), *(F.lit(0).alias(c) for c in ("photo_count", "video_count")))


def finish_story(t: DataFrame) -> DataFrame:
    """``id, story, highlights`` told of a trip's own columns."""
    d, s = F.coalesce("distance_m", F.lit(0)), F.coalesce("duration_sec", F.lit(0))
    n = lambda c: F.coalesce(c, F.lit(0))
    story = F.concat(F.lit("这是一次"), "title", F.lit("的旅程"), F.when(d > 0, F.concat(F.lit("，总行程"), text.distance_text(d))).otherwise(""), F.when(s > 0, F.concat(F.lit("，耗时"), text.duration_text(s))).otherwise(""),
                     F.lit("。旅途中留下了"), n("photo_count").cast("string"), F.lit("张照片和"), n("video_count").cast("string"), F.lit("个视频，记录了美好的瞬间。"))
    lines = F.array_compact(F.array(F.when(n("photo_count") > 0, F.concat(F.lit("拍摄了 "), F.col("photo_count").cast("string"), F.lit(" 张照片"))), F.when(n("video_count") > 0, F.concat(F.lit("录制了 "), F.col("video_count").cast("string"), F.lit(" 个视频"))), F.when(d > 1000, F.concat(F.lit("总行程达 "), text.distance_text(d)))))
    return t.select("id", story.alias("story"), F.array_join(lines, "\n").alias("highlights"))


def summaries(trips: DataFrame, place: DataFrame) -> DataFrame:
    """``id, overview, route, best_moment`` told of a trip and its places in order of start and id."""
    g = place.groupBy(F.col("trip_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_join(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "id", "poi_name"))), lambda x: x["poi_name"])), " → ").alias("_names"),
        F.max_by("poi_name", F.struct("duration_sec", -F.col("id"))).alias("_long"),
    )
    t = trips.join(g, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    over = F.concat(F.lit("本次"), "title", F.lit("共游览了"), F.col("_n").cast("string"), F.lit("个地点"), F.when(F.col("distance_m") > 0, F.concat(F.lit("，总行程"), text.distance_text(F.col("distance_m")))).otherwise(""),
                    F.when(F.col("duration_sec") > 0, F.concat(F.lit("，耗时"), text.duration_text(F.col("duration_sec"), spaced=False))).otherwise(""), F.lit("。留下了美好的回忆。"))
    route = F.when(F.col("_n") == 0, "行程路线信息不足").otherwise(F.concat(F.lit("游览路线："), F.coalesce("_names", F.lit(""))))
    best = F.when(F.col("_long").isNotNull(), F.concat(F.lit("在 "), "_long", F.lit(" 度过了最美好的时光"))).otherwise("行程中的每个瞬间都值得珍藏")
    return t.select("id", over.alias("overview"), route.alias("route"), best.alias("best_moment"))


def place_text(p: Column | None = None) -> Column:
    """What is told of a place's own columns."""
    name = F.when(F.col("poi_name").isNotNull(), F.concat(F.lit("在"), "poi_name")).otherwise("在这个地方")
    part = lambda c, a, b: F.when(F.col(c) > 0, F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))).otherwise("")
    stay = F.when(F.col("duration_sec") > 0, F.concat(F.lit("停留了"), text.duration_text(F.col("duration_sec"), spaced=False))).otherwise("")
    return F.concat(name, stay, part("photo_count", "，拍摄了", "张照片"), part("video_count", "，录制了", "个视频"), F.lit("。"))


#: What is suggested where nothing else is.
SUGGESTIONS = ("建议在最佳时间游览景点，避开人流高峰", "推荐尝试当地特色美食", "建议提前规划路线，节省时间", "推荐购买当地特色纪念品", "建议使用公共交通，方便又环保")
NOWHERE = "未知目的地"


def suggestions(trips: DataFrame, place: DataFrame, told: DataFrame) -> DataFrame:
    """``id, destination, suggestions``: the first word of the trip's first named place, and the lines of more
    than five characters of ``told`` (``trip_id, answer``), else the usual ones."""
    first = place.filter("poi_name is not null").groupBy(F.col("trip_id").alias("id")).agg(F.min_by("poi_name", "id").alias("_name"))
    t = trips.join(first, "id", "left").join(told.select(F.col("trip_id").alias("id"), "answer"), "id", "left")
    lines = F.filter(F.transform(F.split(F.coalesce("answer", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    usual = F.array(*(F.lit(x) for x in SUGGESTIONS))
    return t.select("id", F.coalesce(F.get(F.split("_name", " "), F.lit(0)), F.lit(NOWHERE)).alias("destination"), F.when(F.size(lines) > 0, lines).otherwise(usual).alias("suggestions"))


#: Title and text of a story block of each type; a place is named in its text.
BLOCKS = {
    "TEXT": ("文本记录", None), "PLACE_SUMMARY": ("地点总结", None), "PHOTO": ("照片记录", "拍摄了美丽的照片"), "VIDEO": ("视频记录", "录制了精彩的视频"), "PHOTO_TEXT": ("图文记录", "图文结合的美好回忆"),
    "VIDEO_TEXT": ("视频文字记录", "视频与文字的双重记录"), "MIXED": ("混合记录", "多种形式的记录"), "AI_SUMMARY": ("AI 总结", "AI 生成的行程总结"),
}
OTHER_BLOCK = ("其他记录", "这是一条其他类型的记录")


def story_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (``block_type, answer, content, place_name`` and others) with ``title`` and ``text``: what was
    answered, else what the type says by itself."""
    title, body = F.lit(OTHER_BLOCK[0]), F.lit(OTHER_BLOCK[1])
    own = {"TEXT": F.coalesce("content", F.lit("")), "PLACE_SUMMARY": F.concat(F.lit("在"), F.coalesce("place_name", F.lit("未知地点")), F.lit("的美好时光"))}
    for kind, (name, said) in BLOCKS.items():
        title = F.when(F.col("block_type") == kind, name).otherwise(title)
        body = F.when(F.col("block_type") == kind, own.get(kind, F.lit(said))).otherwise(body)
    return rows.withColumns({"title": title, "text": F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer")).otherwise(body)})


def replace_summaries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored summaries with those of ``new`` in place of the ones of the same trips. ``new`` has
    ``highlights`` as lines in an array; they are stored as one text."""
    rows = new.withColumn("highlights", F.array_join("highlights", "\n")).withColumn("model_name", F.lit("AI Travel Assistant"))
    return stored.join(new.select("trip_id").distinct(), "trip_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def timeline(trips: DataFrame, place: DataFrame, photo: DataFrame, video: DataFrame, note: DataFrame) -> DataFrame:
    """``trip_id, sort_index, sort_time, block_type, ref_type, ref_id, title, text, cover``: start, places, one photo for
    each place (the trip's first), videos, notes (latest first) and end, those with a time; numbered in
    that order, to be shown by time."""
    s = lambda v: F.lit(v).cast("string")

    def part(df: DataFrame, k: int, order: Column, time: str, kind: str, ref: str | None, rid: Column, title: Column, body: Column, cover: Column) -> DataFrame:
        return df.filter(F.col(time).isNotNull()).select("trip_id", F.lit(k).alias("_k"), order.cast("double").alias("_o"), F.col("_id").alias("_id"), F.col(time).cast("timestamp").alias("sort_time"), s(kind).alias("block_type"), s(ref).alias("ref_type"), rid.cast("long").alias("ref_id"), title.alias("title"), body.alias("text"), cover.cast("string").alias("cover"))

    own = lambda df: df.withColumn("_id", F.col("id"))
    t = trips.withColumn("trip_id", F.col("id")).withColumn("_id", F.lit(0).cast("long"))
    none, zero = F.lit(None), F.lit(0)
    first = photo.groupBy("trip_id").agg(F.min_by(F.struct("id", "shot_time_exif", "user_caption", "object_key"), "id").alias("f"))
    pictures = place.select("trip_id", F.col("id").alias("_id")).join(first, "trip_id").select("trip_id", "_id", "f.*")
    note = own(note).withColumn("_late", -F.unix_micros(F.col("created_at").cast("timestamp")))
    parts = [
        part(t, 0, zero, "start_time", "TEXT", None, none, s("行程开始"), F.concat(F.lit("今天开始了"), "title", F.lit("，期待一段美好的旅程！")), none),
        part(own(place), 1, F.col("id"), "start_time", "PLACE_SUMMARY", "PLACE_SUMMARY", F.col("id"), F.coalesce("poi_name", s("地点游览")), place_text(), F.when(F.col("photo_cover_id").isNotNull(), F.concat(F.lit("photo/"), F.col("photo_cover_id").cast("string")))),
        part(pictures, 2, F.col("_id"), "shot_time_exif", "PHOTO", "PHOTO", F.col("id"), s("照片记录"), F.coalesce("user_caption", s("美好的瞬间")), F.col("object_key")),
        part(own(video), 3, F.col("id"), "shot_time_exif", "VIDEO", "VIDEO", F.col("id"), s("视频记录"), F.coalesce("user_caption", s("精彩的视频")), F.col("thumbnail_object_key")),
        part(note, 4, F.col("_late"), "created_at", "TEXT", "TRIP_NOTE", F.col("id"), F.coalesce("title", s("旅程笔记")), F.col("content"), none),
        part(t, 5, zero, "end_time", "TEXT", None, none, s("行程结束"), F.concat("title", F.lit("圆满结束，收获了满满的回忆！")), none),
    ]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    w = Window.partitionBy("trip_id").orderBy("_k", "_o", "_id")
    return whole.withColumn("sort_index", (F.row_number().over(w) - 1).cast("int")).drop("_k", "_o", "_id")

"""The journal's repository queries as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geo

from trailmill.functions import text


def like(column: str, keyword: str) -> Column:
    """Contains, with the wildcards of the keyword left alive."""
    return F.col(column).like(f"%{keyword}%")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in order, with ``total_rows`` of the whole."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return df.orderBy(*order).offset(number * size).limit(size).crossJoin(F.broadcast(total))


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def search_trips(trips: DataFrame, user_id: int | None = None, keyword: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Trips by any of the conditions. Dates are days in China's time; an unknown status or date is
    ignored; with both dates the next midnight belongs to the range, with an end alone it does not."""
    where = F.lit(True)
    if user_id is not None:
        where &= F.col("user_id") == user_id
    if keyword and keyword.strip():
        where &= like("title", keyword.strip())
    if status and status.strip().upper() in ("ACTIVE", "PAUSED", "PROCESSING", "FINISHED"):
        where &= F.col("status") == status.strip().upper()
    day = lambda d: F.to_utc_timestamp(text.parse_date(F.lit(d)), text.ZONE)
    t = F.col("start_time").cast("timestamp")
    lo, hi = (day(start) if start else F.lit(None).cast("timestamp")), (day(end) + F.expr("interval 1 day") if end else F.lit(None).cast("timestamp"))
    where &= F.when(lo.isNotNull() & hi.isNotNull(), t.between(lo, hi)).when(lo.isNotNull(), t >= lo).when(hi.isNotNull(), t < hi).otherwise(True)
    return trips.filter(where)


def without_trips(df: DataFrame, gone: DataFrame, key: str = "trip_id") -> DataFrame:
    """The rows of a child table that stay when the trips ``gone`` (``id``) are deleted."""
    return df.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def delete_trips(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to the trips ``gone`` (``id``): children by their ``trip_id``, the trips
    themselves (``trip``) by their id."""
    return {name: without_trips(df, gone, "id" if name == "trip" else "trip_id") for name, df in tables.items()}


def or_default(trips: DataFrame, boxes: DataFrame) -> DataFrame:
    """A box for every trip, zeros where none is stored."""
    b = trips.select(F.col("id").alias("trip_id")).join(boxes, "trip_id", "left")
    return b.fillna(0.0, [c for c in boxes.columns if c != "trip_id"])


def place_covers(place: DataFrame, photo: DataFrame, video: DataFrame) -> DataFrame:
    """``id, kind, cover_key``: a place's photo if it names one, even if that is gone; else its video.

    Most places name no photo, and rows without a key would all go to one task of the join: a second key, of their own
    id, deals these out."""
    ph = photo.select(F.col("id").alias("photo_cover_id"), F.col("id").alias("_ph"), F.col("object_key").alias("_p"))
    v = video.select(F.col("id").alias("video_cover_id"), F.col("id").alias("_vi"), F.col("thumbnail_object_key").alias("_v"))
    dealt = place.withColumns({"_ph": F.coalesce("photo_cover_id", "id"), "_vi": F.coalesce("video_cover_id", "id")})
    j = dealt.join(ph, ["photo_cover_id", "_ph"], "left").join(v, ["video_cover_id", "_vi"], "left")
    by_photo = F.col("photo_cover_id").isNotNull()
    kind = F.when(by_photo & F.col("_p").isNotNull(), "PHOTO").when(~by_photo & F.col("_v").isNotNull(), "VIDEO")
    return j.select("id", kind.alias("kind"), F.when(by_photo, F.col("_p")).otherwise(F.col("_v")).alias("cover_key"))


def story_places(story: DataFrame, place: DataFrame) -> DataFrame:
    """Blocks with the name of the place that they refer to."""
    p = place.select(F.col("id").alias("_pid"), "poi_name")
    return story.join(p, (F.upper("ref_type") == "PLACE_SUMMARY") & (F.col("ref_id") == F.col("_pid")), "left").select("id", "ref_type", "poi_name")


def story_media(story: DataFrame, photo: DataFrame, video: DataFrame) -> DataFrame:
    """``id, media_key``: key of the photo or video that a block refers to, else its own cover key."""
    ref = F.upper("ref_type")
    p, v = photo.select(F.col("id").alias("_pid"), F.col("object_key").alias("_p")), video.select(F.col("id").alias("_vid"), F.col("thumbnail_object_key").alias("_v"))
    j = story.join(p, (ref == "PHOTO") & (F.col("ref_id") == F.col("_pid")), "left").join(v, (ref == "VIDEO") & (F.col("ref_id") == F.col("_vid")), "left")
    return j.select("id", F.coalesce("_p", "_v", "cover_object_key").alias("media_key"))


def anchors_by_media(anchor: DataFrame, media_id: int, kind: str) -> DataFrame:
    return anchor.filter(((F.col("photo_id") == media_id) & F.lit(kind == "PHOTO")) | ((F.col("video_id") == media_id) & F.lit(kind == "VIDEO")))


def replay(points: DataFrame, photo: DataFrame, video: DataFrame) -> DataFrame:
    """``trip_id, place, kind, id, time_ms``: points, photos and videos of each trip in one order of time;
    media without a time are left out."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    part = lambda df, kind, t: df.select("trip_id", F.lit(kind).alias("kind"), "id", t.alias("time_ms"))
    u = part(points, "POINT", F.col("ts")).unionByName(part(photo, "PHOTO", ms("shot_time_exif"))).unionByName(part(video, "VIDEO", ms("shot_time_exif"))).filter("time_ms is not null")
    w = Window.partitionBy("trip_id").orderBy("time_ms", "kind", "id")
    return u.select("trip_id", F.row_number().over(w).cast("long").alias("place"), "kind", "id", "time_ms")


def nearest_in_time(media: DataFrame, points: DataFrame, key: str, time_ms: str) -> DataFrame:
    """Media rows with the track point of the same key that is nearest in time (``near_id``, ``near_ts``), the
    earlier of two: one sort of both tables together instead of a join on a range."""
    m = media.select(F.col(key).alias("_k"), F.col("id").alias("_mid"), F.col(time_ms).alias("_t"), F.lit(None).cast("struct<ts:long,id:long>").alias("_p"))
    p = points.select(F.col(key).alias("_k"), F.lit(None).cast("long").alias("_mid"), F.col("ts").alias("_t"), F.struct(F.col("ts").cast("long").alias("ts"), F.col("id").cast("long").alias("id")).alias("_p"))
    w = Window.partitionBy("_k").orderBy("_t", F.col("_mid").asc_nulls_first(), "_p")
    u = p.unionByName(m).select("*", F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"), F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_b"))
    after = F.col("_a").isNull() | (F.col("_b.ts") - F.col("_t") < F.col("_t") - F.col("_a.ts"))
    best = F.when(after & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a"))
    return u.filter("_mid is not null").select(F.col("_mid").alias("id"), F.col("_t").alias("time_ms"), best["id"].alias("near_id"), best["ts"].alias("near_ts"))


#: Media are matched to points at most so far away in time, and placed between two points at most so far apart; milliseconds.
NEAR_MS, GAP_MS = 300_000, 120_000


def match_media(media: DataFrame, points: DataFrame, key: str = "trip_id", near_ms: int = NEAR_MS, gap_ms: int = GAP_MS) -> DataFrame:
    """``id, match_method, matched_ts, lat, lng, time_delta_sec, confidence, near_id``: where each medium was taken.

    ``media``: id, ``key``, time_ms, exif_lat, exif_lng, pick_lat, pick_lng, each but the id may be null. By
    precedence: MANUAL_PICK, a place that somebody chose; EXIF_DIRECT, the medium's own; INTERPOLATE, on the line
    between the points before and after, if they are at most ``gap_ms`` apart; TIME_NEAREST, the nearest point in
    time, the earlier of two, if it is at most ``near_ms`` away; else null. Points of no valid place don't count.
    The confidence is 1 for a pick, 0.95 for an own place, and falls from 0.9 by half with the gap around it and
    from 0.8 to 0.1 with the distance in time. One sort brings both tables together: no join on a range.
    """
    side = "struct<ts:long,id:long,lat:double,lng:double>"
    at = F.struct(F.col("ts").cast("long").alias("ts"), F.col("id").cast("long").alias("id"), "lat", "lng")
    m = media.select(F.col(key).alias("_k"), F.struct("id", *(F.col(c).cast("double").alias(c) for c in ("exif_lat", "exif_lng", "pick_lat", "pick_lng"))).alias("_m"), F.col("time_ms").alias("_t"), F.lit(None).cast(side).alias("_p"))
    p = points.filter(geo.valid("lat", "lng")).select(F.col(key).alias("_k"), F.lit(None).cast(m.schema["_m"].dataType).alias("_m"), F.col("ts").alias("_t"), at.alias("_p"))
    # a medium without a time or a key has no neighbours; those without a time are told apart, so that no window holds them all
    timed, lost = m.filter("_t is not null and _k is not null"), m.filter("_t is null or _k is null")
    w = Window.partitionBy("_k").orderBy("_t", F.col("_m.id").asc_nulls_first(), "_p")
    u = p.unionByName(timed).select("*", F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"), F.first("_p", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_b"))
    none = F.lit(None).cast(side)
    u = u.filter("_m is not null").unionByName(lost.select("*", none.alias("_a"), none.alias("_b")))
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    before, after = t - a["ts"], b["ts"] - t
    picked = F.col("_m.pick_lat").isNotNull() & F.col("_m.pick_lng").isNotNull()
    own = F.col("_m.exif_lat").isNotNull() & F.col("_m.exif_lng").isNotNull()
    between = a.isNotNull() & b.isNotNull() & (after > 0) & (before > 0) & (b["ts"] - a["ts"] <= gap_ms)
    nearest = F.when(a.isNull() | (after < before), b).otherwise(a)
    delta = F.abs(nearest["ts"] - t)
    u = u.withColumns({"_n": nearest, "_d": delta})
    method = F.when(picked, "MANUAL_PICK").when(own, "EXIF_DIRECT").when(between, "INTERPOLATE").when(F.col("_d") <= near_ms, "TIME_NEAREST")
    u = u.withColumn("match_method", method)
    is_ = lambda k: F.col("match_method") == k
    share = before / (b["ts"] - a["ts"])
    place = lambda c: F.when(is_("MANUAL_PICK"), F.col(f"_m.pick_{c}")).when(is_("EXIF_DIRECT"), F.col(f"_m.exif_{c}")).when(is_("INTERPOLATE"), a[c] + share * (b[c] - a[c])).when(is_("TIME_NEAREST"), F.col(f"_n.{c}"))
    sure = F.when(is_("MANUAL_PICK"), 1.0).when(is_("EXIF_DIRECT"), 0.95).when(is_("INTERPOLATE"), 0.9 - 0.45 * (b["ts"] - a["ts"]) / gap_ms).when(is_("TIME_NEAREST"), 0.8 - 0.7 * F.col("_d") / near_ms)
    by_time = is_("INTERPOLATE") | is_("TIME_NEAREST")
    return u.select(
        F.col("_m.id").alias("id"),
        "match_method",
        F.when(is_("TIME_NEAREST"), F.col("_n.ts")).otherwise(t).alias("matched_ts"),
        place("lat").alias("lat"),
        place("lng").alias("lng"),
        F.when(by_time, F.floor(F.col("_d") / 1000)).alias("time_delta_sec"),
        sure.alias("confidence"),
        F.when(by_time, F.col("_n.id")).alias("near_id"),
    )

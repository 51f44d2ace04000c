from __future__ import annotations

from pyspark.sql import functions as F

from trailmill import queries as own
from trailmill.sources.tables import derived

SF_DIR = "/root/testdata/sf0.001"


def test_every_event_and_trip_is_matched(spark):
    got = own.queries()["asof_media_all"](spark, SF_DIR)
    points = derived(spark, SF_DIR, "track")
    trip = lambda c: points.select(F.col("id").alias(c), F.col("trip_id").alias(f"{c}_trip"))
    r = got.join(trip("id"), "id").join(trip("near_id"), "near_id")
    assert r.count() == points.count() and r.filter("id_trip <> near_id_trip").count() == 0
    assert r.select("near_id_trip").distinct().count() == points.select("trip_id").distinct().count()


def test_media_without_neighbours(spark):
    """No key, no time, no points, one side alone, points of no valid place, ties, repeated rows."""
    from trailmill.operators.relational import match_media

    media = [(1, 7, 1000, None, None, None, None), (2, None, 1000, None, None, None, None), (3, 7, None, 1.0, 2.0, None, None), (4, 8, 1000, None, None, None, None), (5, 7, 90_000_000, None, None, 3.0, 4.0), (6, 7, 2000, None, None, None, 4.0), (6, 7, 2000, None, None, None, 4.0), (7, 7, 500, None, None, None, None), (8, 7, 4000, 9.0, None, None, None)]
    points = [(10, 7, 1000, 30.0, 114.0), (11, 7, 3000, 31.0, 116.0), (12, 7, 2000, 95.0, 0.0), (13, 9, 5, 1.0, 1.0), (14, None, 1000, 5.0, 5.0)]
    m = spark.createDataFrame(media, "id long, trip_id long, time_ms long, exif_lat double, exif_lng double, pick_lat double, pick_lng double")
    p = spark.createDataFrame(points, "id long, trip_id long, ts long, lat double, lng double")
    got = sorted((r["id"], r["match_method"], r["lat"], r["lng"], r["time_delta_sec"], r["near_id"]) for r in match_media(m, p).collect())
    assert got == [
        (1, "TIME_NEAREST", 30.0, 114.0, 0, 10),
        (2, None, None, None, None, None),
        (3, "EXIF_DIRECT", 1.0, 2.0, None, None),
        (4, None, None, None, None, None),
        (5, "MANUAL_PICK", 3.0, 4.0, None, None),
        (6, "INTERPOLATE", 30.5, 115.0, 1, 10),
        (6, "INTERPOLATE", 30.5, 115.0, 1, 10),
        (7, "TIME_NEAREST", 30.0, 114.0, 0, 10),
        (8, "TIME_NEAREST", 31.0, 116.0, 1, 11),
    ]
    assert match_media(m.limit(0), p).count() == 0 and match_media(m, p.limit(0)).filter("match_method is null").count() == 7


def test_replay_sorts_its_lines_once(spark):
    """Photos, videos and notes share their lines; as three branches each task held three sorts of them."""
    q = own.queries()["trip_replay"](spark, SF_DIR)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    kinds = {"PHOTO": derived(spark, SF_DIR, "photo").count(), "VIDEO": derived(spark, SF_DIR, "video").count(), "NOTE": derived(spark, SF_DIR, "note").count()}
    assert {r["kind"]: r["n"] for r in q.groupBy("kind").agg(F.sum("n").alias("n")).collect()} == kinds


def test_places_without_a_cover_are_dealt_out(spark):
    """Photos and videos bear the ids of the places here: none of them may be taken for a cover."""
    from trailmill.operators.relational import place_covers

    place = spark.range(1000).select("id", F.when(F.col("id") == 7, F.col("id") + 1).alias("photo_cover_id"), F.when(F.col("id") == 9, F.col("id")).alias("video_cover_id"))
    media = spark.range(1000).select("id", F.concat(F.lit("o"), F.col("id")).alias("object_key"), F.concat(F.lit("t"), F.col("id")).alias("thumbnail_object_key"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = place_covers(place, media, media).withColumn("_at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 1000 and {(r["id"], r["kind"], r["cover_key"]) for r in rows if r["kind"] or r["cover_key"]} == {(7, "PHOTO", "o8"), (9, "VIDEO", "t9")}
    sizes = [sum(r["_at"] == k for r in rows) for k in {r["_at"] for r in rows}]
    assert len(sizes) > 1 and max(sizes) < 500

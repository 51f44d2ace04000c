"""Points as clients send them, coerced and appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions import geo

SOURCE, SYSTEM = "WX_FG", "WGS84"


def _number(text: Column, kind: str) -> Column:
    """A number of any text that is one; null otherwise."""
    return F.trim(text).try_cast(kind)


def coerce_points(sent: DataFrame, trips: DataFrame, body: str = "body") -> DataFrame:
    """``user_id, trip_id, ts, lat_enc, lng_enc, accuracy_m, speed_mps, heading_deg, source, raw_coord_type`` of the
    points in ``sent`` (``trip_id`` and JSON text ``body``): numbers may come as numbers or as text.

    A point without latitude, longitude or time is left out, as is one of an unknown trip or a body
    that is no JSON object. Accuracy, speed and heading that are no numbers are null.
    """
    at = lambda k: F.get_json_object(body, f"$.{k}")
    own = trips.select(F.col("id").alias("trip_id"), "user_id")
    p = sent.join(own, "trip_id").select(
        "user_id", "trip_id", _number(at("ts"), "long").alias("ts"), _number(at("lat"), "double").alias("_lat"), _number(at("lng"), "double").alias("_lng"), *(_number(at(k), "float").alias(c) for k, c in (("accuracyM", "accuracy_m"), ("speedMps", "speed_mps"), ("headingDeg", "heading_deg")))
    )
    p = p.filter(F.col("ts").isNotNull() & F.col("_lat").isNotNull() & F.col("_lng").isNotNull())
    return p.select("user_id", "trip_id", "ts", geo.encode_double("_lat").alias("lat_enc"), geo.encode_double("_lng").alias("lng_enc"), "accuracy_m", "speed_mps", "heading_deg", F.lit(SOURCE).alias("source"), F.lit(SYSTEM).alias("raw_coord_type"))


def accepted(sent: DataFrame, points: DataFrame) -> DataFrame:
    """``trip_id, sent, accepted``: what a client is told of each trip."""
    n = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("accepted"))
    return sent.groupBy("trip_id").agg(F.count(F.lit(1)).alias("sent")).join(n, "trip_id", "left").fillna(0, ["accepted"])


def append_points(points: DataFrame, path: str) -> None:
    """Adds points to a stored table."""
    points.write.mode("append").parquet(path)

"""Points that arrive as a stream: the rules of the batch, kept up to date while tracks grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmill.functions import geo
from trailmill.operators import ingest

SENT = "trip_id long, body string"


def read_sent(spark: SparkSession, folder: str) -> DataFrame:
    """What clients send, from JSON files that appear in a folder."""
    return spark.readStream.schema(SENT).json(folder)


def append_stream(sent: DataFrame, trips: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Coerces the points of the stream, each batch against the table of trips, and appends them to a stored table."""
    points = ingest.coerce_points(sent, trips)
    return points.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger or {"availableNow": True}).start()


def live_cells(points: DataFrame, metres: float = 80.0, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``from_time, y, x, lat, lng, samples, trips``: how many points of how many trips each cell of the grid got in
    each window of time; a point that is later than ``late`` is left out. Trips are counted as about
    so many, since a stream keeps no list of them."""
    p = points.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    p = p.withColumns({"_lat": geo.decode_double("lat_enc"), "_lng": geo.decode_double("lng_enc")}).filter(geo.valid_not_origin("_lat", "_lng"))
    g = p.withColumn("c", geo.grid_cell("_lat", "_lng", metres)).groupBy(F.window("at", window).alias("w"), "c.y", "c.x")
    cells = g.agg(F.first("c.lat").alias("lat"), F.first("c.lng").alias("lng"), F.count(F.lit(1)).alias("samples"), F.approx_count_distinct("trip_id").alias("trips"))
    return cells.select(F.col("w.start").alias("from_time"), "y", "x", "lat", "lng", "samples", "trips")

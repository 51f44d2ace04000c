"""Heat maps: grid cells weighted by samples, trips and stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators import clean
from trailmill.operators.grouped import filter_groups

#: Fixed values of the weight.
GRID_M, GRID_LEAST, GRID_MOST = 80, 20, 500
ACCURACY_M, STAY_M, MOST_S, MOST_CELLS = 150.0, 30.0, 300, 600


def grid_metres(asked: int | None) -> int:
    return GRID_M if asked is None else min(GRID_MOST, max(GRID_LEAST, asked))


def heat_cells(points: DataFrame, scope: str = "trip_id", grid: int | None = None) -> DataFrame:
    """``scope, y, x, lat, lng, samples, trips, stay_s, weight, first_ts``: cells of each trip or user.

    Points of good accuracy at valid places, near repeats of one time left out; all count,
    however many a scope has. Each adds 1 and, for the time since the scope's point before, more the longer it stayed.
    The centre is that of the first point in the cell, whose latitude sets the width of cells. What a cell's points
    add is summed in their order, so that a weight half-way between two whole ones is the same in every run.
    """
    m = float(grid_metres(grid))
    p = points.filter(geo.valid_not_origin("lat", "lng", 1e-9) & F.col("ts").isNotNull() & (F.col("accuracy_m").isNull() | (F.col("accuracy_m") <= ACCURACY_M)))
    p = filter_groups(p, [scope], ["ts", "id"], clean.keep_for_heatmap)
    along = Window.partitionBy(scope).orderBy("ts", "id")
    p = p.select("*", geo.grid_cell("lat", "lng", m).alias("c"), F.lag("lat").over(along).alias("_lat"), F.lag("lng").over(along).alias("_lng"), F.lag("ts").over(along).alias("_ts"))
    dt = F.least(F.lit(MOST_S), F.floor((F.col("ts") - F.col("_ts")) / 1000))
    near = geo.haversine("_lat", "_lng", "lat", "lng") <= STAY_M
    p = p.withColumns({"_dt": F.when(F.col("_ts").isNotNull() & (dt > 0), dt)}).withColumns(
        {
            "_stay": F.when(near, F.col("_dt")),
            "_gain": F.when(F.col("_dt").isNull(), 0.0).when(near, F.least(F.lit(6.0), F.col("_dt") / 20.0)).otherwise(F.least(F.lit(2.0), F.col("_dt") / 120.0)),
        }
    )
    cell = [scope, F.col("c.y"), F.col("c.x")]
    in_order = Window.partitionBy(*cell).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_gain", F.sum("_gain").over(in_order))  # nothing is taken away, so the last sum is the largest
    g = p.groupBy(scope, F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("trip_id").alias("trips"), F.coalesce(F.sum("_stay"), F.lit(0)).cast("long").alias("stay_s"), F.max("_gain").alias("_gain"),
        F.min_by("c", F.struct("ts", "id")).alias("c"), F.min("ts").alias("first_ts"),
    )
    total = F.col("samples") + F.col("_gain") + 2.0 * F.col("trips") + F.least(F.lit(20.0), F.col("stay_s") / 30.0) + F.least(F.lit(50.0), 0.8 * F.col("samples"))
    weight = F.greatest(F.lit(1), F.least(F.lit(100), F.floor(total + 0.5).cast("int")))
    return g.select(scope, "y", "x", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"), "samples", "trips", "stay_s", weight.alias("weight"), "first_ts")


def top_cells(cells: DataFrame, scope: str = "trip_id", most: int = MOST_CELLS) -> DataFrame:
    """The ``most`` heaviest cells of each scope; ties by when they were first seen."""
    w = Window.partitionBy(scope).orderBy(F.desc("weight"), "first_ts", "y", "x")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)

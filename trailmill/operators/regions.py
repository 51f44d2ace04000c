"""Tracks and the roads around them, brought together region by region.

A track is matched on the roads of a corridor around it, within the box that the original loads. Boxes are
snapped outwards to a grid of about their own size, so that tracks of one area share a region; a busy
region is dealt out in parts of whole tracks, and each part has the roads of the cells that the corridors of
its tracks cover. So the roads of a task grow with the length of its tracks, not with the size of
their boxes. No road passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators.routing import FIELDS
from trailmill.params import DEFAULTS, MatchParams
from trailmill.scratch import materialise

#: Degrees of the finest grid of regions and of the cells of corridors; points and cells in a part of a region, about.
CELL, TILE = 0.1, 0.05
PART_POINTS, PART_TILES = 10_000, 400
REGION = ["_k", "_y0", "_y1", "_x0", "_x1"]


def network_boxes(points: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, points, radius_km, south, north, west, east``: the box of roads to load for each track,
    around the centre of its own box and growing with its diagonal."""
    b = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("points"), F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lng").alias("_w"), F.max("lng").alias("_e"))
    b = b.withColumn("radius_km", F.greatest(F.lit(p.least_radius_km), geo.haversine("_s", "_w", "_n", "_e") / 2000.0 + 1.0))
    km, lat, lng = F.col("radius_km") + p.box_buffer_km, (F.col("_s") + F.col("_n")) / 2.0, (F.col("_w") + F.col("_e")) / 2.0
    dlat, dlng = km / 111.0, km / F.greatest(F.lit(1e-6), F.cos(F.radians(lat)) * 111.0)
    return b.select("trip_id", "points", "radius_km", (lat - dlat).alias("south"), (lat + dlat).alias("north"), (lng - dlng).alias("west"), (lng + dlng).alias("east"))


def corridors(points: DataFrame, boxes: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, _ty, _tx``: the tiles within ``corridor_km`` north, south, east or west of a track that meet its box.

    Two neighbouring points are joined by the ways that the search for a route would take: one that leaves the
    corridor is twice its width longer than the step, and counts as none.
    """
    at = points.select("trip_id", F.floor(F.col("lat") / TILE).alias("_ty"), F.floor(F.col("lng") / TILE).alias("_tx")).distinct()
    far = F.least(F.greatest(F.abs("_ty"), F.abs(F.col("_ty") + 1)) * TILE, F.lit(89.0))  # the side towards the pole
    high = F.ceil(F.lit(p.corridor_km / 111.0 / TILE)).cast("int")
    wide = F.ceil(p.corridor_km / (111.0 * F.cos(F.radians(far))) / TILE).cast("int")
    near = lambda c, n: F.explode(F.sequence(F.col(c) - n, F.col(c) + n)).alias(c)
    tiles = at.select("trip_id", "_ty", near("_tx", wide)).distinct().select("trip_id", near("_ty", high), "_tx").distinct()
    low = lambda c: F.col(c) * TILE
    inside = geo.boxes_meet(low("_ty"), low("_ty") + TILE, low("_tx"), low("_tx") + TILE, F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    return tiles.join(boxes, "trip_id").filter(inside).select("trip_id", "_ty", "_tx")


def regions_of(boxes: DataFrame, cover: DataFrame, part_points: int = PART_POINTS, part_tiles: int = PART_TILES) -> DataFrame:
    """``trip_id``, the region of its box (``REGION``: level and cells of the grid) and ``_part``. A region has so many
    parts that each has about ``part_points`` points, and ``part_tiles`` tiles if it has more than these."""
    size = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    b = boxes.withColumn("_k", F.greatest(F.lit(0), F.ceil(F.log2(size / CELL))).cast("int"))
    cell = F.pow(F.lit(2.0), F.col("_k")) * CELL
    b = b.withColumns({n: F.floor(F.col(c) / cell) for n, c in zip(REGION[1:], ("south", "north", "west", "east"), strict=True)})
    tiles = cover.join(b.select("trip_id", *REGION), "trip_id").groupBy(*REGION, "_ty", "_tx").agg(F.count(F.lit(1)).alias("_n"))
    tiles = tiles.groupBy(*REGION).agg(F.count(F.lit(1)).alias("_own"), F.sum("_n").alias("_all"))
    by_tiles = F.when(F.col("_own") > part_tiles, F.ceil(F.col("_all") / part_tiles)).otherwise(1)
    parts = b.groupBy(*REGION).agg(F.sum("points").alias("_points")).join(tiles, REGION)
    parts = parts.select(*REGION, F.greatest(F.ceil(F.col("_points") / part_points), by_tiles).alias("_parts"))
    return b.join(parts, REGION).select("trip_id", *REGION, F.pmod(F.xxhash64("trip_id"), F.col("_parts")).cast("int").alias("_part"))


def roads_of(regions: DataFrame, cover: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` for every part of every region: those whose box meets a tile of its corridors, some more than once."""
    tiles = cover.join(regions, "trip_id").select(*REGION, "_part", "_ty", "_tx").distinct()
    at = lambda f, a, b: F.floor(f(a, b) / TILE)
    e = edges.select(*FIELDS).withColumn("_ty", F.explode(F.sequence(at(F.least, "lat1", "lat2"), at(F.greatest, "lat1", "lat2")))).withColumn("_tx", F.explode(F.sequence(at(F.least, "lng1", "lng2"), at(F.greatest, "lng1", "lng2"))))
    return tiles.join(e, ["_ty", "_tx"]).select(*(F.col(c).alias(c) for c in (*REGION, "_part")), *FIELDS)


def map_with_roads(rows: DataFrame, points: DataFrame, edges: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, p: MatchParams = DEFAULTS) -> DataFrame:
    """``fn`` of the rows of each part of a region (they bear a ``trip_id``) and of its roads. ``points`` are
    the tracks that say where the trips are. Rows and roads of a part are held by one task."""
    boxes = materialise(network_boxes(points, p), "boxes")
    cover = materialise(corridors(points, boxes, p), "corridors")
    regions = materialise(regions_of(boxes, cover), "regions")
    keys = [*REGION, "_part"]
    left = rows.join(regions, "trip_id").groupBy(*keys)
    right = roads_of(regions, cover, edges).groupBy(*keys)
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a.drop_columns(keys), b.drop_columns(keys))

    return left.cogroup(right).applyInArrow(run, target)

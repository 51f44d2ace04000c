"""Schemas of the journal: eleven tables and the road graph."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, D, FL, S, B, BIN, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.StringType(), T.BooleanType(), T.BinaryType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


PRIVACY = ("PUBLIC", "FRIENDS", "PRIVATE")
STATUS = ("ACTIVE", "PAUSED", "PROCESSING", "FINISHED")

TABLES = {
    "user": _table(id=L, open_id=S, union_id=S, nickname=S, avatar_url=S, default_privacy_mode=S, created_at=TS, updated_at=TS),
    "trip": _table(id=L, user_id=L, title=S, timezone=S, status=S, privacy_mode=S, start_time=TS, end_time=TS, distance_m=L, duration_sec=L, photo_count=I, video_count=I, summary_text=S, generated_at=TS),
    "track_point": _table(id=L, user_id=L, trip_id=L, ts=L, lat_enc=BIN, lng_enc=BIN, accuracy_m=FL, speed_mps=FL, heading_deg=FL, source=S, raw_coord_type=S, created_at=TS),
    "photo": _table(id=L, user_id=L, trip_id=L, object_key=S, file_hash=S, shot_time_exif=TS, lat_enc=BIN, lng_enc=BIN, user_caption=S, privacy_mode=S, is_cover=B, created_at=TS),
    "video": _table(id=L, user_id=L, trip_id=L, object_key=S, thumbnail_object_key=S, file_hash=S, shot_time_exif=TS, lat_enc=BIN, lng_enc=BIN, duration_sec=I, file_size=L, resolution=S, user_caption=S, processing_status=S, privacy_mode=S, created_at=TS),
    "anchor": _table(id=L, user_id=L, trip_id=L, photo_id=L, video_id=L, matched_ts=L, match_method=S, time_delta_sec=I, confidence=FL, manual_override=B, lat_enc=BIN, lng_enc=BIN),
    "place_summary": _table(id=L, user_id=L, trip_id=L, center_lat_enc=BIN, center_lng_enc=BIN, geohash=S, start_time=TS, end_time=TS, duration_sec=L, city=S, district=S, poi_name=S, photo_cover_id=L, video_cover_id=L, photo_count=I, video_count=I, privacy_level=S, user_notes=S, user_tags=S, generated_at=TS),
    "trip_bbox": _table(trip_id=L, min_lat=FL, max_lat=FL, min_lng=FL, max_lng=FL),
    "trip_note": _table(id=L, user_id=L, trip_id=L, anchor_ts=L, lat_enc=BIN, lng_enc=BIN, title=S, content=S, privacy_mode=S, created_at=TS),
    "story_block": _table(id=L, user_id=L, trip_id=L, block_type=S, ref_type=S, ref_id=L, sort_time=TS, sort_index=I, title=S, text=S, cover_object_key=S, is_hidden=B),
    "trip_ai_summary": _table(id=L, user_id=L, trip_id=L, overview=S, highlights=S, route_summary=S, best_moment=S, model_name=S, version=S, generated_at=TS),
}

POINT = T.StructType([T.StructField("lat", D), T.StructField("lng", D)])
ROAD_NODE = _table(node_id=L, lat=D, lng=D, degree=I)
ROAD_EDGE = _table(edge_id=L, way_id=L, start_node=L, end_node=L, lat1=D, lng1=D, lat2=D, lng2=D, name=S, type=S, one_way=B, max_speed=I, layer=I, bridge=B, tunnel=B, ramp=B, node_degree=I, length_m=D)

"""The geographic formulas over numpy arrays, for sequential work on groups."""

from __future__ import annotations

import math

import numpy as np

from trailmill.functions.geo import DEGREE_M, EARTH_M


def haversine(lat1, lng1, lat2, lng2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    s, t = np.sin((p2 - p1) / 2), np.sin(np.radians(lng2 - lng1) / 2)
    a = s * s + np.cos(p1) * np.cos(p2) * t * t
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def metres(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    """``haversine`` of plain numbers, for single pairs."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    s, t = math.sin((p2 - p1) / 2), math.sin(math.radians(lng2 - lng1) / 2)
    a = s * s + math.cos(p1) * math.cos(p2) * t * t
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def bearing(lat1, lng1, lat2, lng2):
    p1, p2, d = np.radians(lat1), np.radians(lat2), np.radians(lng2 - lng1)
    return np.degrees(np.arctan2(np.sin(d) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(d))) % 360.0


def angle_difference(a, b):
    d = np.abs(np.asarray(a) - b) % 360.0
    return np.where(d > 180.0, 360.0 - d, d)


def segment_projection(lat, lng, lat1, lng1, lat2, lng2):
    """(distance, offset, lat, lng) of the nearest points of segments."""
    east = np.cos(np.radians((lat + lat1 + lat2) / 3.0)) * DEGREE_M
    dx, dy = (lng2 - lng1) * east, (lat2 - lat1) * DEGREE_M
    px, py = (lng - lng1) * east, (lat - lat1) * DEGREE_M
    size = dx * dx + dy * dy
    with np.errstate(invalid="ignore", divide="ignore"):
        t = np.where(size > 0, np.clip((px * dx + py * dy) / size, 0.0, 1.0), 0.0)
    return np.hypot(px - t * dx, py - t * dy), np.sqrt(size) * t, lat1 + t * (lat2 - lat1), lng1 + t * (lng2 - lng1)

"""The map of a trip, put together again in plain Python from cleaned, matched and rebuilt stretches."""

from __future__ import annotations

import math

import pytest
from tests.plain_matching import dist
from tests.test_matching import RAW, town

from trailmill.operators import clean, matching, roads
from trailmill.params import MatchParams
from trailmill.plans import trip_map

STYLE = {("matched", "DRIVING"): ("#FF9500", 4), ("matched", "WALKING"): ("#34C759", 4), ("reconstructed", "DRIVING"): ("#007AFF", 6), ("reconstructed", "WALKING"): ("#22C55E", 6)}
POINT = "id long, user_id long, trip_id long, ts long, lat double, lng double, accuracy_m double, speed_mps double, heading_deg double, raw_coord_type string"


def shifted(lat, lng):
    """A place as it is drawn, in the offset system."""
    x, y = lng - 105.0, lat - 35.0
    common = (20 * math.sin(6 * x * math.pi) + 20 * math.sin(2 * x * math.pi)) * 2 / 3
    dlat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * math.sqrt(abs(x)) + common + (20 * math.sin(y * math.pi) + 40 * math.sin(y / 3 * math.pi)) * 2 / 3 + (160 * math.sin(y / 12 * math.pi) + 320 * math.sin(y * math.pi / 30)) * 2 / 3
    dlng = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * math.sqrt(abs(x)) + common + (20 * math.sin(x * math.pi) + 40 * math.sin(x / 3 * math.pi)) * 2 / 3 + (150 * math.sin(x / 12 * math.pi) + 300 * math.sin(x / 30 * math.pi)) * 2 / 3
    rad = math.radians(lat)
    e2, a = 0.00669342162296594323, 6378245.0
    m = 1 - e2 * math.sin(rad) ** 2
    return lat + dlat * 180 / (a * (1 - e2) / (m * math.sqrt(m)) * math.pi), lng + dlng * 180 / (a / math.sqrt(m) * math.cos(rad) * math.pi)


def points():
    """Drives along a street, a walk after one, a drive far from all roads, a point alone, one of no valid place."""
    rows, k = [], 0

    def add(trip, ts, lat, lng, v, h=None, kind="WGS84"):
        nonlocal k
        k += 1
        rows.append((k, 1, trip, 1_700_000_000_000 + ts * 1000, lat, lng, 10.0, v, h, kind))

    for i in range(14):
        add(1, i * 10, 30.59361, 114.3005 + i * 0.0005, 9.0, 90.0)
    for i in range(14):
        add(1, 150 + i * 10, 30.5945 + i * 0.0001, 114.3075 + (i % 3) * 0.00003, 0.8)
    add(1, 290, 30.5945 + 13 * 0.0001, 114.3075, 0.8)
    for i in range(12):
        add(2, i * 10, 30.7 + i * 0.0008, 114.5, 9.5, 0.0)
    add(3, 5, 30.5936, 114.301, 1.0)
    add(4, 0, 95.0, 114.3, 1.0)
    for i in range(8):
        add(5, i * 10, 30.5918 + 0.00001 * (i % 2), 114.3001 + i * 0.0006, 10.0, 90.0, "GCJ02" if i % 2 else None)
    return rows


@pytest.fixture(scope="module")
def given(spark):
    edges = matching.materialise(roads.finish_edges(spark.createDataFrame(town(), RAW)), "town")
    return spark.createDataFrame(points(), POINT), edges


def plain_lines(spark, given, p):
    """(trip, layer, segment) to (mode, [(ts, lat, lng)]) as drawn."""
    pts, edges = given
    found: dict = {}
    for r in sorted(trip_map.stretches(pts, edges, p).collect(), key=lambda r: (r["trip_id"], r["ts"], r["id"])):
        found.setdefault((r["trip_id"], r["segment"], r["mode"]), []).append(r)
    names = dict(enumerate(found))
    frame = lambda mode: spark.createDataFrame([tuple(k if c == "trip_id" else r[c] for c in pts.columns) for k, key in names.items() if key[2] == mode for r in found[key]], POINT)
    by_trip = lambda df, cols, order: {k: [tuple(r[c] for c in cols) for r in sorted(df.filter(f"trip_id = {k}").collect(), key=lambda r: order(r))] for k in names}
    place, time = ("ts", "lat", "lng"), lambda r: (r["ts"], r["id"])
    walks, drives = by_trip(clean.walking(frame("WALKING"), p), place, time), clean.driving(frame("DRIVING"), p)
    cleaned = by_trip(drives, place, time)
    drives = drives.filter(drives["trip_id"].isin([k for k, v in cleaned.items() if len(v) > 1]))
    m = matching.match(drives, edges, p)
    rebuilt = matching.reconstruct(m, edges, p)
    poor = {r["trip_id"] for r in matching.quality(m, rebuilt).filter("poor").collect()}
    matched, again = by_trip(m, ("ts", "m_lat", "m_lng"), time), by_trip(rebuilt, place, lambda r: r["pos"])
    out = {}
    for k, (trip, segment, mode) in names.items():
        as_came = [(r["ts"], r["lat"], r["lng"]) for r in found[trip, segment, mode]]
        for layer, of_drive in (("matched", matched), ("reconstructed", again)):
            if mode == "WALKING":
                line = walks[k] or as_came
            elif len(cleaned[k]) < 2:
                line = as_came
            else:
                line = cleaned[k] if p.quality_fallback and k in poor else of_drive[k]
            out[trip, layer, segment] = (mode, [(t, *shifted(a, b)) for t, a, b in line])
    return out, poor


def metres(line):
    return math.floor(sum(dist(*a[1:], *b[1:]) for a, b in zip(line, line[1:], strict=False)) + 0.5)


def close(got, want):
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1:] for x in got] == [pytest.approx(x[1:], abs=1e-8) for x in want]


def test_lines_and_styles(spark, given):
    """With both switches turned; as they are by default, the lines are part of the next test."""
    pts, edges = given
    p = MatchParams(quality_fallback=True, use_sensor_fields=False)
    want, poor = plain_lines(spark, given, p)
    assert {m for m, _ in want.values()} == {"WALKING", "DRIVING"} and {t for t, _, _ in want} == {1, 2, 5}
    lines = matching.materialise(trip_map.segment_lines(pts, edges, p), "lines")
    got: dict = {}
    for r in lines.orderBy("trip_id", "layer", "segment", "pos").collect():
        got.setdefault((r["trip_id"], r["layer"], r["segment"]), []).append((r["ts"], r["lat"], r["lng"]))
    assert set(got) == set(want)
    for k, (_, line) in want.items():
        close(got[k], line)
    for r in trip_map.segment_polylines(lines).collect():
        mode, line = want.pop((r["trip_id"], r["layer"], r["segment"]))
        assert (r["mode"], r["points"], r["distance_m"]) == (mode, len(line), metres(line))
        assert (r["color"], r["width"]) == STYLE[r["layer"], mode]
        close([(x["ts"], x["lat"], x["lng"]) for x in r["line"]], line)
    assert all(len(line) < 2 for _, line in want.values())


def test_whole_lines_and_view(spark, given):
    pts, edges = given
    p = MatchParams()
    segments, _ = plain_lines(spark, given, p)
    places = spark.createDataFrame([(9, 1, 200.0, 30.59, 114.3, "b", 3700), (8, 1, 100.0, 30.6, 114.31, "a", 59), (7, 1, 50.0, 91.0, 0.0, "nowhere", 5), (6, 2, 1.0, 30.7, 114.5, None, None)], "id long, trip_id long, start_time double, lat double, lng double, poi_name string, duration_sec long")
    view = {r["trip_id"]: r for r in trip_map.map_view(pts, edges, places, p).collect()}
    raw: dict = {}
    for r in clean.to_wgs84(pts).orderBy("trip_id", "ts", "id").collect():
        if abs(r["lat"]) <= 90:
            raw.setdefault(r["trip_id"], []).append((r["ts"], *shifted(r["lat"], r["lng"])))
    for trip, line in raw.items():
        close([(x["ts"], x["lat"], x["lng"]) for x in view[trip]["raw"]["line"]], line)
        assert view[trip]["raw"]["distance_m"] == metres(line)
        for layer in ("matched", "reconstructed"):
            joined = [x for k in sorted(segments) if k[:2] == (trip, layer) for x in segments[k][1]]
            kept: list = []
            for x in joined:
                if not (kept and x[0] == kept[-1][0] and dist(*x[1:], *kept[-1][1:]) < 1.5):
                    kept.append(x)
            close([(x["ts"], x["lat"], x["lng"]) for x in view[trip][layer]["line"]], kept or line)
    assert [(m["key"], m["title"]) for m in view[1]["markers"]] == [("place-8", "a"), ("place-9", "b")]
    assert [m["key"] for m in view[2]["markers"]] == ["place-6"] and view[3]["markers"] is None
    assert view[3]["stretches"] is None and {(s["layer"], s["segment"]) for s in view[1]["stretches"]} == {(la, s) for t, la, s in segments if t == 1}

"""Cleaning, motion, files and ingest against plain versions and small files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.plain_matching import angle, dist

from trailmill.functions import arrays, geo
from trailmill.operators import clean, ingest, motion, roads
from trailmill.params import DEFAULTS as P
from trailmill.sources import track_files

POINTS = "id long, user_id long, trip_id long, ts long, lat double, lng double, accuracy_m double, speed_mps double, heading_deg double"


def walk(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    lat, lng, ts, rows = 30.59, 114.30, 1_700_000_000_000, []
    for i in range(n):
        ts += r.choice([200, 4_000, 8_000, 20_000])
        if i % 15 < 9:
            lat, lng = lat + r.gauss(0.00004, 0.00003), lng + r.gauss(0.00002, 0.00004)
        jump = 0.003 if i % 17 == 16 else 0.0
        rows.append((i, 1, seed, ts, lat + jump, lng, r.choice([None, 8.0, 70.0, 190.0]), r.choice([None, 0.3, 1.4, -1.0]), r.choice([None, 40.0, -1.0])))
    return rows


def bearing(a, b):
    return float(arrays.bearing(np.float64(a["lat"]), np.float64(a["lng"]), np.float64(b["lat"]), np.float64(b["lng"])))


def plain_fill(p):
    out = []
    for i, q in enumerate(p):
        back, ahead = (p[i - 1] if i else None), (p[i + 1] if i + 1 < len(p) else None)
        d = lambda a, b: dist(a["lat"], a["lng"], b["lat"], b["lng"])
        h, v = q["heading_deg"], q["speed_mps"]
        if h is None or h < 0:
            h = bearing(back, q) if back and d(back, q) >= 3 else bearing(q, ahead) if ahead and d(q, ahead) >= 3 else h
        if v is None or v < 0:
            a, b = (back, q) if back else (q, ahead)
            v = d(a, b) / (max(1, b["ts"] - a["ts"]) / 1000) if b else 0.0
        out.append(q | {"heading_deg": h, "speed_mps": v})
    return out


def plain_walking(rows):
    d = lambda a, b: dist(a["lat"], a["lng"], b["lat"], b["lng"])
    speed = lambda m, ms: m / (ms / 1000) if ms > 0 else 0.0
    p = plain_fill([q for q in rows if q["accuracy_m"] is None or q["accuracy_m"] <= 180])
    kept = p[:1]
    for q in p[1:]:
        if not (q["ts"] - kept[-1]["ts"] < 1000 and d(kept[-1], q) < 2):
            kept.append(q)
    p, kept = kept, kept[:1]
    for i in range(1, len(p) - 1):
        a, q, b = kept[-1], p[i], p[i + 1]
        x, y, z = d(a, q), d(q, b), d(a, b)
        fast = speed(x, q["ts"] - a["ts"]) > 7.5 and speed(y, b["ts"] - q["ts"]) > 7.5 and z < max(12, 0.45 * (x + y))
        if not (fast or ((q["accuracy_m"] or 0) > 60 and x > 35 and y > 35 and z < 15)):
            kept.append(q)
    p = plain_fill([*kept, p[-1]] if len(p) > 1 else kept)
    smooth = []
    for i, q in enumerate(p):
        w = {k: 1 / (1 + abs(k)) / (1 + (p[i + k]["accuracy_m"] if p[i + k]["accuracy_m"] is not None else 15) / 30) for k in range(-2, 3) if 0 <= i + k < len(p)}
        mean = {c: sum(v * p[i + k][c] for k, v in w.items()) / max(sum(w.values()), 1) for c in ("lat", "lng")}
        smooth.append(q if i in (0, len(p) - 1) or len(p) < 3 else q | mean)
    p, out, i = smooth, [], 0
    while i < len(p):
        e = i + 1
        while e < len(p) and d(p[i], p[e]) <= 10:
            e += 1
        known = [q["speed_mps"] for q in p[i:e] if q["speed_mps"] is not None]
        if not (e - i > 1 and p[e - 1]["ts"] - p[i]["ts"] >= 15_000 and sum(known) / max(len(known), 1) <= 1.2):
            e = i + 1
        w = p[i:e]
        acc = [q["accuracy_m"] for q in w if q["accuracy_m"] is not None]
        out.append(w[len(w) // 2] | {"lat": sum(q["lat"] for q in w) / len(w), "lng": sum(q["lng"] for q in w) / len(w), "accuracy_m": sum(acc) / len(acc) if acc else None})
        i = e
    p, kept = out, out[:1]
    for i in range(1, len(p) - 1):
        a, q, b = kept[-1], p[i], p[i + 1]
        if d(a, q) >= 4 or q["ts"] - a["ts"] >= 30_000 or angle(bearing(a, q), bearing(q, b)) >= 28:
            kept.append(q)
    p = [*kept, p[-1]] if len(p) > 1 else kept
    return plain_fill([q | {"heading_deg": None, "speed_mps": None} for q in p])


def test_walking_clean_equals_plain(spark):
    rows = [x for s in range(4) for x in walk(s)] + [(900, 1, 9, 5, 30.0, 114.0, None, None, None)]
    d = spark.createDataFrame(rows, POINTS)
    got: dict = {}
    for r in clean.walking(d).orderBy("trip_id", "ts", "id").collect():
        got.setdefault(r["trip_id"], []).append(r)
    names = [c.split()[0] for c in POINTS.split(", ")]
    for trip in (0, 1, 2, 3, 9):
        want = plain_walking([dict(zip(names, x, strict=True)) for x in sorted(rows, key=lambda x: (x[3], x[0])) if x[2] == trip])
        assert [r["id"] for r in got[trip]] == [q["id"] for q in want]
        for r, q in zip(got[trip], want, strict=True):
            assert (r["lat"], r["lng"], r["speed_mps"]) == pytest.approx((q["lat"], q["lng"], q["speed_mps"]), abs=1e-6)
    assert len(got[0]) < 55


def plain_modes(e):
    """Modes of one trip before and after smoothing, True for driving."""
    raw, now = [], False
    for r in e:
        drive, go = r["drive_score"], r["walk_score"]
        if (r["max_speed"] >= 9 and r["near_ratio"] >= 0.4) or drive >= go + 0.7:
            now = True
        elif go >= drive + 0.4:
            now = False
        elif now and r["near_ratio"] >= 0.55 and r["median_speed"] >= 2.8:
            now = True
        elif not now and (r["median_speed"] <= 2.6 or r["off_ratio"] >= 0.35 or r["stay_ratio"] >= 0.45):
            now = False
        else:
            now = r["near_ratio"] >= 0.75 and r["median_speed"] >= 3.2
        raw.append(now)
    modes = list(raw)
    for _ in range(3):
        runs, s = [], 0
        for i in range(1, len(modes) + 1):
            if i == len(modes) or modes[i] != modes[s]:
                runs.append((s, i, modes[s]))
                s = i
        new = list(modes)
        for k, (s, t, mode) in enumerate(runs):
            if t - s >= P.least_run_points and e[t - 1]["ts"] - e[s]["ts"] >= P.least_run_ms:
                continue
            before, after = (runs[k - 1][2] if k else None), (runs[k + 1][2] if k + 1 < len(runs) else None)
            mean = lambda c, s=s, t=t: sum(x[c] for x in e[s:t]) / (t - s)
            if before is not None and before == after:
                to = before
            elif not mode and mean("near_ratio") >= 0.75 and mean("avg_speed") >= 3.5 and (before or after):
                to = True
            elif mode and (mean("avg_speed") <= 3 or mean("off_ratio") >= 0.45) and False in (before, after):
                to = False
            elif before is None or after is None:
                to = after if before is None else before
            else:
                to = before if runs[k - 1][1] - runs[k - 1][0] >= runs[k + 1][1] - runs[k + 1][0] else after
            if to is not None:
                new[s:t] = [to] * (t - s)
        if new == modes:
            break
        modes = new
    return raw, modes


def test_modes_and_segments_equal_plain(spark):
    r = random.Random(2)
    rows = []
    for trip in range(30):
        fast = False
        for i in range(40):
            fast = fast if r.random() < 0.85 else not fast
            v = r.uniform(3, 9.5) if fast else r.uniform(0.2, 4)
            near = r.choice([0.2, 0.6, 0.8, 1.0])
            rows.append((trip * 100 + i, trip, i * 10_000, v, v * 1.3, near, 1 - near, r.choice([0.0, 0.4, 0.6]), v, r.choice([0.0, 0.8, 1.2, 2.0, 2.6]), r.choice([0.0, 0.7, 1.2, 1.7])))
    ev = spark.createDataFrame(rows, "id long, trip_id long, ts long, median_speed double, max_speed double, near_ratio double, off_ratio double, stay_ratio double, avg_speed double, drive_score double, walk_score double")
    got = motion.classify(ev)
    by_trip: dict = {}
    for x in got.orderBy("trip_id", "ts").collect():
        by_trip.setdefault(x["trip_id"], []).append(x)
    names = ev.columns
    for trip, found in by_trip.items():
        raw, modes = plain_modes([dict(zip(names, x, strict=True)) for x in rows if x[1] == trip])
        assert [x["mode_raw"] == "DRIVING" for x in found] == raw, trip
        assert [x["mode"] == "DRIVING" for x in found] == modes, trip
    seg = motion.segments(ev, got)
    assert seg.agg(F.sum("points")).first()[0] == len(rows)
    assert seg.groupBy("trip_id").agg(F.max("segment").alias("s"), F.count(F.lit(1)).alias("n")).filter("s + 1 <> n").count() == 0


def test_track_files(spark, tmp_path):
    plt = tmp_path / "a.plt"
    plt.write_text("\r\n".join([*["head"] * 6, "39.9,116.3,0,492,39744.1,2008-10-23,02:53:04", "x,116.3,0,492,39744.1,2008-10-23,02:53:10", "39.9,116.4", "39.8,116.5,0,492,39744.1,2008-10-23,02:53:15", "39.8,116.5,0,492,39744.1,2008-13-23,02:53:15", ""]))
    got = [(r["lat"], r["lng"], r["ts"], r["heading"], r["speed"]) for r in track_files.read_plt(spark, str(tmp_path / "*.plt")).orderBy("ts").collect()]
    assert got == [(39.9, 116.3, 1224730384000, 0.0, 1.2), (39.8, 116.5, 1224730395000, 0.0, 1.2)]
    ev = tmp_path / "b.csv"
    ev.write_text("﻿vehicle_id,id,ts,time_beijing,lat,lng,speed_mps,heading_deg,accuracy_m,running_status,charge_status,odometer_m\nv,1,1700000000000,t,30.5,114.3,7.5,90,8,1,0,125430.0\nv,2,bad,t,30.5,114.3,7.5,90,8,1,0,1\nv,3,1700000010000,t,30.5\n", encoding="utf-8")
    assert [(r["lat"], r["lng"], r["ts"], r["heading"], r["speed"]) for r in track_files.read_ev(spark, str(ev)).collect()] == [(30.5, 114.3, 1700000000000, 90.0, 7.5)]


def test_ingest_appends(spark, tmp_path):
    trips = spark.createDataFrame([(1, 7)], "id long, user_id long")
    sent = spark.createDataFrame([(1, '{"lat": "30.5", "lng": 114, "ts": 5, "headingDeg": "n"}'), (1, '{"lat": 30.5, "ts": 5}'), (2, '{"lat": 1, "lng": 1, "ts": 1}'), (1, "no json"), (1, None)], "trip_id long, body string")
    p = ingest.coerce_points(sent, trips)
    for _ in range(2):
        ingest.append_points(p, str(tmp_path / "points"))
    rows = spark.read.parquet(str(tmp_path / "points")).withColumn("lat", geo.decode_double("lat_enc")).collect()
    assert [(r["user_id"], r["ts"], r["lat"], r["heading_deg"], r["source"]) for r in rows] == [(7, 5, 30.5, None, "WX_FG")] * 2
    assert {(r["trip_id"], r["sent"], r["accepted"]) for r in ingest.accepted(sent, p).collect()} == {(1, 4, 1), (2, 1, 0)}


def test_thin_network_is_loaded_wider(spark):
    nodes = [(k, 30.59 + k * 0.01, 114.30) for k in range(12)]
    ways = [(1, [0, 1], {"highway": "primary"}), (2, [9, 10, 11], {"highway": "primary"})]
    n, w = spark.createDataFrame(nodes, "id long, lat double, lng double"), spark.createDataFrame(ways, "id long, node_ids array<long>, tags map<string, string>")
    near = roads.around(n, w, 30.59, 114.30, 2.5)
    assert {r["way_id"] for r in near.collect()} == {1} and {r["way_id"] for r in roads.around_or_wider(n, w, 30.59, 114.30, 2.5, 4.0).collect()} == {1, 2}
    assert {r["way_id"] for r in roads.around_or_wider(n, w, 30.59, 114.30, 1.5, 4.0).collect()} == {1}  # so small a one may be thin

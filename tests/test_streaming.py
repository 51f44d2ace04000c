from __future__ import annotations

import json

from pyspark.sql import functions as F

from trailmill.operators import ingest
from trailmill.streaming import points as streams


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"trip_id": t, "body": json.dumps(b)}) for t, b in rows))


def test_stream_appends_what_the_batch_accepts(spark, tmp_path):
    trips = spark.createDataFrame([(1, 7), (2, 8)], "id long, user_id long")
    sent = tmp_path / "sent"
    start = 1_700_000_100_000
    first = [(1, {"lat": 30.5, "lng": 114.3, "ts": start + k * 1000}) for k in range(20)] + [(1, {"lat": "x", "lng": 1, "ts": 1}), (9, {"lat": 1, "lng": 1, "ts": 1})]
    write(sent, "a.json", first)
    to, state = str(tmp_path / "points"), str(tmp_path / "state")
    streams.append_stream(streams.read_sent(spark, str(sent)), trips, to, state).awaitTermination()
    second = [(2, {"lat": "30.5", "lng": "114.3", "ts": start + 400_000})]
    write(sent, "b.json", second)
    streams.append_stream(streams.read_sent(spark, str(sent)), trips, to, state).awaitTermination()
    got = spark.read.parquet(to)
    batch = ingest.coerce_points(spark.createDataFrame([(t, json.dumps(b)) for t, b in first + second], streams.SENT), trips)
    assert got.count() == batch.count() == 21 and got.exceptAll(batch).count() == 0


def test_live_cells(spark, tmp_path):
    start = 1_700_000_100_000
    trips = spark.createDataFrame([(1, 7), (2, 8)], "id long, user_id long")
    rows = [(1 + k % 2, json.dumps({"lat": 30.5, "lng": 114.3, "ts": start + k * 1000})) for k in range(30)] + [(1, json.dumps({"lat": 30.6, "lng": 114.3, "ts": start + 3_000_000}))]
    points = ingest.coerce_points(spark.createDataFrame(rows, streams.SENT), trips)
    want = {(r["samples"], r["trips"]) for r in streams.live_cells(points).collect()}
    assert want == {(30, 2), (1, 1)}
    path, state = str(tmp_path / "p"), str(tmp_path / "s")
    points.coalesce(1).write.parquet(path)
    stream = streams.live_cells(spark.readStream.schema(points.schema).parquet(path))
    stream.writeStream.format("memory").queryName("cells").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    closed = spark.table("cells")  # the window of the last point is still open
    assert closed.count() == 1 and closed.select(F.sum("samples")).first()[0] == 30

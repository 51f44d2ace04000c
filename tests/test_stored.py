"""Stored tables: upserts and deletions by path, and what a crash or a second writer leaves."""

from __future__ import annotations

import os

import pytest

from trailmill.sources import stored
from trailmill.sources.stored import Conflict, Journal


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture
def journal(spark, tmp_path):
    trip = spark.createDataFrame([(k, k % 3, f"t{k}") for k in range(40)], "id long, user_id long, title string")
    photo = spark.createDataFrame([(100 + k, k % 40 if k % 9 else None, f"p{k}") for k in range(120)], "id long, trip_id long, object_key string")
    summary = spark.createDataFrame([(k, "old") for k in range(0, 40, 2)], "trip_id long, overview string")
    return Journal.open(spark, str(tmp_path / "journal")).create({"trip": trip, "photo": photo, "summary": summary})


def test_upsert(spark, journal):
    before = dict(journal.manifest["summary"]["parts"])
    new = journal.upsert("summary", spark.createDataFrame([("new", 4), ("first", 5)], "overview string, trip_id long"), "trip_id")
    want = [(k, "new" if k == 4 else "first" if k == 5 else "old") for k in sorted([*range(0, 40, 2), 5])]
    assert rows(new.read("summary"), "trip_id", "overview") == sorted(want, key=str)
    assert rows(Journal.open(spark, journal.root).read("summary"), "trip_id", "overview") == sorted(want, key=str)
    assert rows(journal.read("summary"), "trip_id", "overview") == sorted([(k, "old") for k in range(0, 40, 2)], key=str)  # the old version
    after = new.manifest["summary"]["parts"]
    assert sum(after.get(k) == p for k, p in before.items()) >= len(before) - 2 and new.manifest["photo"] == journal.manifest["photo"]
    with pytest.raises(ValueError, match="more than one"):
        new.upsert("summary", spark.createDataFrame([("a", 4), ("b", 4)], "overview string, trip_id long"), "trip_id")


def test_an_upsert_moves_a_row_to_another_trip(spark, journal):
    moved = journal.upsert("photo", spark.createDataFrame([(101, 33, "moved"), (102, None, "loose")], "id long, trip_id long, object_key string"), "id")
    got = {r["id"]: (r["trip_id"], r["object_key"]) for r in moved.read("photo").collect()}
    assert got[101] == (33, "moved") and got[102] == (None, "loose") and len(got) == moved.read("photo").count() == 120


def test_cascade(spark, journal):
    gone = spark.createDataFrame([(3,), (4,), (4,), (999,), (None,)], "id long")
    new = journal.delete_trips(gone)
    assert new.version == journal.version + 1
    assert {r["id"] for r in new.read("trip").collect()} == set(range(40)) - {3, 4}
    assert {r["trip_id"] for r in new.read("photo").collect()} == (set(range(40)) | {None}) - {3, 4}
    assert {r["trip_id"] for r in new.read("summary").collect()} == set(range(0, 40, 2)) - {4}
    empty = new.delete_trips(new.read("trip"))
    assert empty.read("trip").count() == 0 and {r["trip_id"] for r in empty.read("photo").collect()} == {None}
    again = empty.upsert("trip", spark.createDataFrame([(1, 1, "x")], "id long, user_id long, title string"), "id")
    assert rows(again.read("trip"), "id", "title") == [(1, "x")]


def test_a_crash_leaves_the_old_version(spark, journal, monkeypatch):
    gone = spark.createDataFrame([(3,)], "id long")
    real, written = Journal._write, []

    def fails_at_the_third(self, table, df):
        written.append(table)
        if len(written) == 3:
            raise RuntimeError("lost")
        return real(self, table, df)

    monkeypatch.setattr(Journal, "_write", fails_at_the_third)
    with pytest.raises(RuntimeError, match="lost"):
        journal.delete_trips(gone)
    monkeypatch.setattr(Journal, "_write", real)
    now = Journal.open(spark, journal.root)
    assert now.version == journal.version and now.manifest == journal.manifest and now.read("trip").count() == 40
    monkeypatch.setattr(stored, "_named", lambda root, version: (_ for _ in ()).throw(RuntimeError("lost at the last step")))
    with pytest.raises(RuntimeError, match="last step"):
        journal.delete_trips(gone)
    monkeypatch.undo()
    assert Journal.open(spark, journal.root).read("photo").count() == 120


def test_two_writers(spark, journal):
    row = spark.createDataFrame([(1, 1, "x")], "id long, user_id long, title string")
    first = journal.upsert("trip", row, "id")
    with pytest.raises(Conflict):
        journal.upsert("trip", row, "id")
    assert Journal.open(spark, journal.root).version == first.version
    assert first.vacuum() > 0 and first.read("trip").count() == 40 and first.read("photo").count() == 120
    assert len([n for n in os.listdir(journal.root) if n.startswith("manifest")]) == 1


def test_parts_are_written_where_their_rows_are(spark, tmp_path):
    """Each task writes the rows that it has: no part is gathered in one task."""
    photo = spark.range(4000).repartition(4).selectExpr("id", "id % 500 trip_id", "cast(id as string) object_key")
    j = Journal.open(spark, str(tmp_path / "large")).create({"photo": photo})
    files = [sum(f.endswith(".parquet") for f in os.listdir(p)) for p in j.manifest["photo"]["parts"].values()]
    assert len(files) == stored.PARTS and min(files) > 1
    gone = spark.range(0, 500, 2)
    assert rows(j.delete_trips(gone).read("photo"), "id") == sorted([(k,) for k in range(4000) if k % 2], key=str)

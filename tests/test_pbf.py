"""Map files: what the writer writes is read back, and so are files of another make, byte by byte."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmill.sources import pbf

LONG = st.integers(-(1 << 63), (1 << 63) - 1)


@given(st.lists(LONG))
def test_packed_numbers(values):
    assert pbf.packed(pbf.put_packed(values)).tolist() == values
    small = [v >> 1 for v in values]
    assert pbf.packed(pbf.put_packed(small, True), True).tolist() == small


@given(st.lists(LONG))
def test_few_and_many_numbers(values):
    assert pbf.numbers(pbf.put_packed(values)) == values
    assert pbf._put_array(np.array(values, np.int64)) == pbf.put_packed(values, True)
    assert pbf.numbers(pbf.put_packed(values, True), True) == pbf.packed(pbf.put_packed(values, True), True).tolist()


def nodes(spark, n=5000):
    tags = F.when(F.col("id") % 100 == 0, F.create_map(F.lit("highway"), F.lit("crossing"), F.lit("名"), F.col("id").cast("string")))
    return spark.range(n).select((F.col("id") * 3 - 7000).alias("id"), (F.col("id") * 0.001 - 2).alias("lat"), (F.lit(179.9) - F.col("id") * 0.07).alias("lng"), tags.alias("tags"))


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/map"
    ways = spark.createDataFrame([(1, [5, -7, 5, 1 << 40], {"name": "É", "": "empty"}), (2, [], {}), (-3, [9], None)], "id long, node_ids array<long>, tags map<string,string>")
    pbf.write_pbf(nodes(spark).repartition(3), path, block_rows="700")
    pbf.write_pbf(ways.coalesce(1), f"file://{path}")
    assert not [f for f in os.listdir(path) if f.endswith(".tmp")]
    key = lambda df: sorted((r["id"], round(r["lat"], 7), round(r["lng"], 7), sorted((r["tags"] or {}).items())) for r in df.collect())
    assert key(pbf.read_nodes(spark, path)) == key(nodes(spark))
    got = {r["id"]: (r["node_ids"], r["tags"]) for r in pbf.read_ways(spark, path).collect()}
    assert got == {1: ([5, -7, 5, 1 << 40], {"name": "É", "": "empty"}), 2: ([], {}), -3: ([9], {})}


def test_blocks_are_dealt_and_pruned(spark, tmp_path):
    path = f"{tmp_path}/map"
    pbf.write_pbf(nodes(spark).repartitionByRange(2, "id").sortWithinPartitions("id"), path, block_rows="500")
    index = pbf.block_index(spark, path)
    rows = index.collect()
    assert len(rows) in (10, 11) and sum(r["nodes"] for r in rows) == 5000 and sum(r["ways"] for r in rows) == 0
    assert pbf.read_nodes(spark, path, split_bytes="1").rdd.getNumPartitions() == len(rows)
    box = (-1.9005, -1.7005, -180.0, 180.0)
    inside = {r["id"] for r in nodes(spark).filter("lat between -1.9005 and -1.7005").collect()}
    pruned = pbf.read_nodes(spark, path, box, index, split_bytes="1")
    assert {r["id"] for r in pruned.collect()} == inside == {r["id"] for r in pbf.read_nodes(spark, path, box).collect()}
    assert pruned.rdd.getNumPartitions() == sum(r["south"] <= -1.7005 and r["north"] >= -1.9005 for r in rows) < len(rows)
    assert pbf.read_nodes(spark, path, (80.0, 81.0, 0.0, 1.0), index).count() == 0


def test_an_index_decodes_no_way(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/map"
    ways = spark.range(100).select("id", F.array("id", F.col("id") + 1).alias("node_ids"), F.create_map(F.lit("name"), F.col("id").cast("string")).alias("tags"))
    pbf.write_pbf(ways.coalesce(1), path, block_rows="30")
    (file,) = pbf.files_of(path)
    monkeypatch.setattr(pbf.Block, "_tags", lambda *_: pytest.fail("tags of a way were decoded"))
    reader, rows = pbf.PbfReader({"path": path, "kind": "blocks"}), []
    for span in reader.partitions():
        rows += [r for b in reader.read(span) for r in b.to_pylist()]
    assert [(r["file"], r["nodes"], r["ways"]) for r in rows] == [(file, 0, 30)] * 3 + [(file, 0, 10)]


def framed(kind, content, raw=False):
    blob = pbf.put(1, content) if raw else pbf.put(2, len(content)) + pbf.put(3, zlib.compress(content))
    head = pbf.put(1, kind) + pbf.put(2, b"index data of some writer") + pbf.put(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def test_files_of_another_make(spark, tmp_path):
    """Plain nodes, a scale and an origin of its own, blocks that are not compressed, dense nodes with other details."""
    zig = lambda v: v << 1 if v >= 0 else -v * 2 - 1
    strings = b"".join(pbf.put(1, s) for s in (b"", b"highway", b"stop"))
    plain = pbf.put(1, pbf.put(1, zig(-5)) + pbf.put(2, pbf.put_packed([1])) + pbf.put(3, pbf.put_packed([2])) + pbf.put(8, zig(1000)) + pbf.put(9, zig(-2000)))
    dense = pbf.put(2, pbf.put(1, pbf.put_packed([7, 1], True)) + pbf.put(5, b"\x0a\x02\x01\x01") + pbf.put(8, pbf.put_packed([10, -30], True)) + pbf.put(9, pbf.put_packed([0, 5], True)))
    block = pbf.put(1, strings) + pbf.put(2, plain) + pbf.put(2, dense) + pbf.put(17, 1000) + pbf.put(19, 2_000_000_000) + pbf.put(20, -3_000_000_000)
    with open(tmp_path / "one.osm.pbf", "wb") as f:
        f.write(framed(b"OSMHeader", pbf.put(4, b"OsmSchema-V0.6")) + framed(b"OSMData", block, raw=True) + framed(b"Other", b"x") + framed(b"OSMData", block))
    one = f"{tmp_path}/one.osm.pbf"
    got = sorted((r["id"], round(r["lat"], 9), round(r["lng"], 9), tuple((r["tags"] or {}).items())) for r in pbf.read_nodes(spark, one).collect())
    assert got == sorted([(-5, 2.001, -3.002, (("highway", "stop"),)), (7, 2.00001, -3.0, ()), (8, 1.99998, -2.999995, ())] * 2)
    assert pbf.read_ways(spark, one).count() == 0
    with open(tmp_path / "bad.osm.pbf", "wb") as f:
        blob = pbf.put(4, b"lzma")
        head = pbf.put(1, b"OSMData") + pbf.put(3, len(blob))
        f.write(struct.pack(">I", len(head)) + head + blob)
    with pytest.raises(Exception, match="other than zlib"):
        pbf.read_nodes(spark, f"{tmp_path}/bad.osm.pbf").count()


def test_empty_folder(spark, tmp_path):
    assert pbf.read_nodes(spark, str(tmp_path)).count() == 0
    assert np.array_equal(pbf.packed(b""), np.zeros(0))

"""Map files in the public OSM PBF format as a Spark data source: ``spark.read.format("osm_pbf")``.

A file is a row of blocks, each compressed for itself. The plan looks at the heads of the blocks alone and
deals neighbouring blocks to partitions of about ``split_bytes``; tasks read and decode their own. Files are
opened through ``pyarrow.fs``, so a path may be local or any store that it knows.

``block_index`` describes the blocks, and ``read_nodes`` with a box reads only those that can hold a node of
the box. ``write.format("osm_pbf")`` makes one file for each partition.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from trailmill.functions import geo

NODES = "id long, lat double, lng double, tags map<string,string>"
WAYS = "id long, node_ids array<long>, tags map<string,string>"
BLOCKS = "file string, at long, size long, nodes long, ways long, south double, north double, west double, east double, least_id long, most_id long"
SCHEMAS = {"nodes": NODES, "ways": WAYS, "blocks": BLOCKS}
SPLIT_BYTES = 8 << 20
#: Rows of a block, and of an Arrow batch.
BLOCK_ROWS = 8000

_STRINGS = pa.map_(pa.string(), pa.string())
_NODES = pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("tags", _STRINGS)])
_WAYS = pa.schema([("id", pa.int64()), ("node_ids", pa.list_(pa.int64())), ("tags", _STRINGS)])
_WHOLE, _REAL = pa.int64(), pa.float64()
_BLOCKS = pa.schema([("file", pa.string()), ("at", _WHOLE), ("size", _WHOLE), ("nodes", _WHOLE), ("ways", _WHOLE), ("south", _REAL), ("north", _REAL), ("west", _REAL), ("east", _REAL), ("least_id", _WHOLE), ("most_id", _WHOLE)])

# --- the wire format


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        c = b[i]
        value |= (c & 0x7F) << shift
        i, shift = i + 1, shift + 7
        if c < 0x80:
            return value, i


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message: whole numbers, or the bytes of what has a length."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def packed(b: bytes, signed: bool = False) -> np.ndarray:
    """The numbers of a packed field; ``signed`` ones alternate around zero."""
    if not b:
        return np.zeros(0, np.int64)
    x = np.frombuffer(b, np.uint8)
    first = np.concatenate(([0], np.flatnonzero(x < 0x80)[:-1] + 1))
    place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    v = np.add.reduceat((x & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)
    return ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64) if signed else v.view(np.int64)


def numbers(b: bytes, signed: bool = False) -> list[int]:
    """The same as a list; a few numbers are read one by one, since arrays cost more than these."""
    if len(b) > 200:
        return packed(b, signed).tolist()
    out, i = [], 0
    while i < len(b):
        v, i = (b[i], i + 1) if b[i] < 0x80 else _varint(b, i)
        out.append(_signed(v) if signed else _whole(v))
    return out


def _signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _whole(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def put(number: int, value: int | bytes) -> bytes:
    """One field of a message."""
    if isinstance(value, int):
        return _put_varint(number << 3) + _put_varint(value)
    return _put_varint(number << 3 | 2) + _put_varint(len(value)) + value


_BYTES = [bytes((v,)) for v in range(0x80)]


def _put_varint(v: int) -> bytes:
    if 0 <= v < 0x80:
        return _BYTES[v]
    out = bytearray()
    v &= (1 << 64) - 1
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def put_packed(values: Iterable[int], signed: bool = False) -> bytes:
    return b"".join(_put_varint((v << 1) ^ (v >> 63) if signed else v) for v in values)


def _put_array(v: np.ndarray) -> bytes:
    """``put_packed`` of signed numbers, for many of them."""
    u = ((v << 1) ^ (v >> 63)).view(np.uint64)
    n = 1 + sum((u >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 10))
    at = np.repeat(np.arange(len(u)), n)
    place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    low = (u[at] >> (7 * place).astype(np.uint64)) & np.uint64(0x7F)
    return (low.astype(np.uint8) | np.where(place < n[at] - 1, 0x80, 0).astype(np.uint8)).tobytes()


def _steps(values: list[int]) -> list[int]:
    """Each number less the one before it, in 64 bits."""
    return [((b - a + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63) for a, b in zip([0, *values], values)]


# --- blocks of a file


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, p


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder whose names end in ``.pbf``, in order."""
    fs, p = _open(path)
    if fs.get_file_info(p).type != pafs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(p))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.base_name.endswith(".pbf"))


def block_places(path: str) -> list[tuple[int, int]]:
    """(place, size) of the data blocks of a file; reads their heads alone."""
    fs, p = _open(path)
    out = []
    with fs.open_input_file(p) as f:
        end, at = f.size(), 0
        while at < end:
            f.seek(at)
            (n,) = struct.unpack(">I", f.read(4))
            head = dict(fields(f.read(n)))
            if head[1] == b"OSMData":
                out.append((at + 4 + n, head[3]))
            at += 4 + n + head[3]
    return out


def _content(blob: bytes) -> bytes:
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("a block is compressed in a way other than zlib")


class Block:
    """A decoded block: its strings, its scale and its groups."""

    def __init__(self, blob: bytes):
        self._table, self.groups = b"", []
        scale, lat0, lng0 = 100, 0, 0
        for k, v in fields(_content(blob)):
            if k == 1:
                self._table = v
            elif k == 2:
                self.groups.append(v)
            elif k == 17:
                scale = v
            elif k == 19:
                lat0 = _whole(v)
            elif k == 20:
                lng0 = _whole(v)
        self.lat = lambda x: 1e-9 * (lat0 + scale * x)
        self.lng = lambda x: 1e-9 * (lng0 + scale * x)

    @cached_property
    def strings(self) -> list[str]:
        return [s.decode("utf-8", "replace") for _, s in fields(self._table)]

    def _tags(self, keys: bytes, values: bytes) -> list[tuple[str, str]]:
        return [(self.strings[a], self.strings[b]) for a, b in zip(numbers(keys), numbers(values), strict=True)]

    def node_arrays(self, with_tags: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """ids, latitudes, longitudes and tags, group by group; plain nodes and dense ones."""
        for g in self.groups:
            plain = []
            for k, v in fields(g):
                if k == 1:
                    plain.append(dict(fields(v)))
                elif k == 2:
                    d = dict(fields(v))
                    ids = np.cumsum(packed(d.get(1, b""), True))
                    tags = self._dense_tags(packed(d.get(10, b"")), len(ids)) if with_tags else []
                    yield ids, self.lat(np.cumsum(packed(d.get(8, b""), True))), self.lng(np.cumsum(packed(d.get(9, b""), True))), tags
            if plain:
                tags = [self._tags(n.get(2, b""), n.get(3, b"")) for n in plain] if with_tags else []
                at = lambda k: np.array([_signed(n.get(k, 0)) for n in plain], np.int64)  # noqa: B023, E731
                yield at(1), self.lat(at(8)), self.lng(at(9)), tags

    def _dense_tags(self, pairs: np.ndarray, n: int) -> list[list[tuple[str, str]]]:
        """Key and value numbers of the nodes in order; a zero ends those of a node."""
        out: list[list[tuple[str, str]]] = [[] for _ in range(n)]
        x, i, node = pairs.tolist(), 0, 0
        while i < len(x):
            if x[i] == 0:
                node, i = node + 1, i + 1
            else:
                out[node].append((self.strings[x[i]], self.strings[x[i + 1]]))
                i += 2
        return out

    def ways(self) -> Iterator[tuple[int, list[int], list[tuple[str, str]]]]:
        for g in self.groups:
            for k, v in fields(g):
                if k == 3:
                    d = dict(fields(v))
                    refs = [_whole(x & ((1 << 64) - 1)) for x in accumulate(numbers(d.get(8, b""), True))]
                    yield _whole(d.get(1, 0)), refs, self._tags(d.get(2, b""), d.get(3, b""))

    def count_ways(self) -> int:
        """How many ways, none of them decoded."""
        return sum(k == 3 for g in self.groups for k, _ in fields(g))


# --- the data source


class _Span(InputPartition):
    def __init__(self, file: str, blocks: list[tuple[int, int]]):
        super().__init__(None)
        self.file, self.blocks = file, blocks


class PbfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "nodes")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        chosen = options.get("blocks")
        self.chosen = None if chosen is None else {f: set(at) for f, at in json.loads(chosen).items()}

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in files_of(self.path):
            wanted = block_places(file) if self.chosen is None else [b for b in block_places(file) if b[0] in self.chosen.get(file, ())]
            held: list[tuple[int, int]] = []
            for b in wanted:
                if held and sum(n for _, n in held) + b[1] > self.split:
                    out.append(_Span(file, held))
                    held = []
                held.append(b)
            if held:
                out.append(_Span(file, held))
        return out or [_Span("", [])]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, p = _open(partition.file)
        with fs.open_input_file(p) as f:
            for at, size in partition.blocks:
                f.seek(at)
                yield from getattr(self, f"_{self.kind}")(Block(f.read(size)), partition.file, at, size)

    def _nodes(self, block: Block, *_) -> Iterator[pa.RecordBatch]:
        for ids, lat, lng, tags in block.node_arrays():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lat), pa.array(lng), pa.array(tags, _STRINGS)], schema=_NODES)

    def _ways(self, block: Block, *_) -> Iterator[pa.RecordBatch]:
        found = list(block.ways())
        if found:
            ids, nodes, tags = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(tags, _STRINGS)], schema=_WAYS)

    def _blocks(self, block: Block, file: str, at: int, size: int) -> Iterator[pa.RecordBatch]:
        parts = [x[:3] for x in block.node_arrays(False) if len(x[0])]
        ways = block.count_ways()
        ids, lat, lng = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 3
        box = (lat.min(), lat.max(), lng.min(), lng.max(), int(ids.min()), int(ids.max())) if parts else (None,) * 6
        row = (file, at, size, len(ids), ways, *box)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class PbfWriter(DataSourceArrowWriter):
    """One file for each partition, of nodes or of ways. A file has its name only once the job is committed."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.rows = int(options.get("block_rows", BLOCK_ROWS))

    def write(self, iterator) -> WriterCommitMessage:
        fs, folder = _open(self.path)
        fs.create_dir(folder)
        p = f"{folder}/part-{uuid.uuid4().hex}.osm.pbf.tmp"
        with fs.open_output_stream(p) as f:
            f.write(_framed(b"OSMHeader", put(4, b"OsmSchema-V0.6") + put(4, b"DenseNodes")))
            held: list[pa.RecordBatch] = []
            for batch in iterator:
                held.append(batch)
                n = sum(b.num_rows for b in held)
                if n >= self.rows:
                    t = pa.Table.from_batches(held)
                    for at in range(0, n - n % self.rows, self.rows):
                        f.write(self._block(t.slice(at, self.rows)))
                    held = t.slice(n - n % self.rows).to_batches()
            if sum(b.num_rows for b in held):
                f.write(self._block(pa.Table.from_batches(held)))
        return _Written(p)

    def commit(self, messages) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.path, m.path.removesuffix(".tmp"))

    def abort(self, messages) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)

    def _block(self, t: pa.Table) -> bytes:
        c = {n: t.column(n).combine_chunks() for n in t.column_names}
        if missing := [n for n in ("id", "lat", "lng") if n in c and c[n].null_count]:
            raise ValueError(f"rows without {', '.join(missing)}")
        place: dict[str, int] = {"": 0}
        tags = self._tags(c["tags"], place) if "tags" in c else [((), ())] * t.num_rows
        if "node_ids" in self.columns:
            refs = zip(c["id"].to_pylist(), tags, c["node_ids"].to_pylist(), strict=True)
            group = b"".join(put(3, put(1, i) + put(2, put_packed(k)) + put(3, put_packed(v)) + put(8, put_packed(_steps(r or []), True))) for i, (k, v), r in refs)
        else:
            steps = lambda v: _put_array(np.diff(v, prepend=np.int64(0)))
            scaled = lambda n: steps(np.rint(c[n].to_numpy() * 1e7).astype(np.int64))
            pairs = [x for k, v in tags for x in (*(y for kv in zip(k, v, strict=True) for y in kv), 0)] if "tags" in c else []
            group = put(2, put(1, steps(c["id"].to_numpy())) + put(8, scaled("lat")) + put(9, scaled("lng")) + put(10, put_packed(pairs)))
        strings = b"".join(put(1, s.encode()) for s in place)
        return _framed(b"OSMData", put(1, strings) + put(2, group))

    def _tags(self, tags: pa.MapArray, place: dict[str, int]) -> list[tuple[list[int], list[int]]]:
        """The numbers of the keys and of the values of each row; ``place`` gives every string its number."""
        number = lambda s: place.setdefault(s, len(place))
        if tags.null_count:
            rows = [r or () for r in tags.to_pylist()]
            return [([number(k) for k, _ in r], [number(v) for _, v in r]) for r in rows]
        at = tags.offsets.to_pylist()
        k, v = ([number(x) for x in c.slice(at[0], at[-1] - at[0]).to_pylist()] for c in (tags.keys, tags.items))
        return [(k[a - at[0] : b - at[0]], v[a - at[0] : b - at[0]]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _framed(kind: bytes, content: bytes) -> bytes:
    blob = put(2, len(content)) + put(3, zlib.compress(content))
    head = put(1, kind) + put(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


class PbfSource(DataSource):
    """Options: ``kind`` (nodes, ways or blocks), ``split_bytes``, ``blocks`` (JSON: file to places), ``block_rows``."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PbfWriter(dict(self.options), schema.fieldNames())


# --- tables


def _read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").options(kind=kind, **options).load(path)


def read_ways(spark: SparkSession, path: str, **options) -> DataFrame:
    """``id, node_ids, tags`` of the ways of a file or a folder of files."""
    return _read(spark, path, "ways", **options)


def block_index(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row for each block: file, place, size, nodes, ways, and box and range of ids of its nodes. To be
    written once; it is as much smaller than the file as a block is than its row."""
    return _read(spark, path, "blocks", **options)


def read_nodes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, index: DataFrame | None = None, **options) -> DataFrame:
    """``id, lat, lng, tags``; with a box (south, north, west, east) those inside, its borders included. With an ``index``
    only blocks that can hold such a node are read: their places, one for each block of the box, are part of the plan."""
    if box is None:
        return _read(spark, path, "nodes", **options)
    if index is not None:
        south, north, west, east = box
        meets = (F.col("nodes") > 0) & geo.boxes_meet(F.col("south"), F.col("north"), F.col("west"), F.col("east"), south, north, west, east)
        chosen: dict[str, list[int]] = {}
        for r in index.filter(meets).select("file", "at").collect():
            chosen.setdefault(r["file"], []).append(r["at"])
        options["blocks"] = json.dumps(chosen)
    d = _read(spark, path, "nodes", **options)
    return d.filter(geo.in_box("lat", "lng", *box))


def write_pbf(df: DataFrame, path: str, **options) -> None:
    """Adds files of nodes (``id, lat, lng`` and maybe ``tags``) or of ways (``id, node_ids, tags``) to a folder."""
    df.sparkSession.dataSource.register(PbfSource)
    df.write.format("osm_pbf").options(**options).mode("append").save(path)

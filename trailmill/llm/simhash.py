"""Operator 6, SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprints go to shards by some of their bits, so that near ones meet in at least one. A shard is
a BK-tree: children are keyed by the Hamming distance to their parent, and a search follows only the
edges within the radius. Every link comes from such a search. The trees are not broadcast, since their
size is that of the corpus and a broadcast passes the driver: the shuffle brings every shard its tree
and its searches, and a shard that is too large for one task becomes several trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import join_counted, materialise

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Bits are counted for so many hashes at a time; a byte can hold the count.
COUNT_ROWS = 255
#: Values in a shard at most if they are evenly spread, and in one tree of an uneven shard; one
#: fingerprint in so many tells which shards are uneven; nodes that are visited at a time.
SHARD, PART, SAMPLE, STEPS = 256, 20_000, 64, 1 << 20
#: For similarities: words of 64 bits in a fingerprint, tables, those of a first round, and bits that
#: choose a shard of a table.
WIDE, TABLES, FIRST_TABLES, KEY_BITS = 4, 96, 12, 16
#: Texts of a candidate group that are compared with all others in the first round, doubled in every
#: further one, and the texts of a group that meet them in one part of the join.
PIVOTS, PART_ROWS = 32, 512


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in 64-bit values, the lowest first."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    whole = len(h) // COUNT_ROWS * COUNT_ROWS
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, COUNT_ROWS, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def _wider(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of what the first stands for."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of lower-cased words in order, repeats included; fewer words than
    ``shingle`` are one shingle, no words none."""
    words = (text or b"").lower().split()  # of bytes: ASCII blanks and letters only
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    return np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, words64: int = 1, distinct: bool = False) -> bytes:
    """SimHash of the shingles, repeats included unless ``distinct``, ``words64`` times 64 bits, each
    word little-endian; all zero without words. The first word's bits are those of the hashes."""
    h = shingle_hashes(text, shingle)
    if distinct:
        h = np.unique(h)
    n = len(h)
    if not n:
        return bytes(8 * words64)
    ones = np.zeros((words64, 64), np.int64)
    for i in range(0, n, 1 << 14):
        part = h[i : i + (1 << 14)]
        for k in range(words64):
            ones[k] += _bit_counts(_wider(part, k) if k else part)
    return np.packbits(ones.ravel() * 2 > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words64: int = 1, distinct: bool = False) -> DataFrame:
    """``id_col``, ``_th`` (a hash of the text) and ``_fp`` of every row: a signed long if the fingerprint
    has 64 bits, else binary."""
    d = docs.select(id_col, F.xxhash64(text_col).alias("_th"), F.col(text_col).cast("binary").alias("_text"))
    schema = d.drop("_text").withColumn("_fp", F.lit(0).cast("long") if words64 == 1 else F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle, words64, distinct) for t in b.column(2)]
            col = pa.array(np.frombuffer(b"".join(fp), "<i8")) if words64 == 1 else pa.array(fp, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), col], names=[id_col, "_th", "_fp"])

    return d.mapInArrow(run, schema)


def _values(col: pa.Array) -> np.ndarray:
    """One row of 64-bit words for each fingerprint."""
    if pa.types.is_integer(col.type):
        return col.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(len(col), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BKForest:
    """One BK-tree for each shard, all in arrays: every value is a node, its edge bears its Hamming
    distance to the node above, and no two edges of a node bear the same.

    ``shard`` names the tree of each value and never falls. A search goes down in step for all that
    ask: from a node at distance d only edges from d - radius to d + radius are followed, and none to a
    branch whose values were all taken out. ``visited`` counts the nodes that were compared.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values, self.span, self.visited = values, 64 * values.shape[1] + 1, 0
        self.above, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = []
        members, group = np.arange(n), shard
        above = via = np.full(len(np.unique(shard)), -1, np.int64)
        while len(members):
            head = np.concatenate(([True], group[1:] != group[:-1]))
            node = members[head]
            self.above[node], edge[node] = above, via
            self.levels.append(node)
            at = node[np.cumsum(head) - 1][~head]
            members = members[~head]
            d = _distances(values[members], values[at])
            group = at * self.span + d
            order = np.argsort(group, kind="stable")
            members, group = members[order], group[order]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
            above, via = np.divmod(group[first], self.span)
        below = np.flatnonzero(self.above >= 0)
        key = self.above[below] * self.span + edge[below]
        order = np.argsort(key)
        self.edges, self.ends = key[order], below[order]
        self.fill()

    def fill(self) -> None:
        """All values stand in their trees (again)."""
        self.left = np.ones(len(self.values), bool)
        self.under = np.ones(len(self.values), np.int64)
        for level in self.levels[:0:-1]:
            np.add.at(self.under, self.above[level], self.under[level])

    def take_out(self, nodes: np.ndarray) -> None:
        """The values are found no more; their nodes stay as signposts."""
        self.left[nodes] = False
        while len(nodes):
            np.subtract.at(self.under, nodes, 1)
            nodes = self.above[nodes]
            nodes = nodes[nodes >= 0]

    def search(self, asked: np.ndarray, roots: np.ndarray, radius: int, label: np.ndarray | None = None, uniform: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes found, row of ``asked`` that found each). With ``label`` an asker that has found one
        value of a label goes into no branch in which all values bear that label (``uniform``, else -1)."""
        q, node = np.arange(len(asked)), roots
        found, by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = np.zeros(0, np.int64)
        n = len(self.values)
        while len(q):
            self.visited += len(q)
            d = _distances(asked[q], self.values[node])
            hit = (d <= radius) & self.left[node]
            found.append(node[hit])
            by.append(q[hit])
            lo = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            q, node = np.repeat(q, many), self.ends[at]
            go = self.under[node] > 0
            if label is not None:
                known = np.union1d(known, by[-1] * n + label[found[-1]])
                go &= (uniform[node] < 0) | ~np.isin(q * n + uniform[node], known)
            q, node = q[go], node[go]
        return np.concatenate(found), np.concatenate(by)


def _slices(size: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of about ``most`` in sum, one at least."""
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield slice(start, end)
        start = end


def forest_links(values: np.ndarray, shard: np.ndarray, radius: int, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, BKForest]:
    """Rows (left, right) that span, shard by shard, the groups which values within the radius of each
    other form, and the forest that was searched.

    Each shard grows one group at a time: the first value left is taken out of its tree and asks for
    those near it, these are linked, taken out and ask in turn, until none is found. So a dense group is
    found by few searches of a tree that shrinks, and links are fewer than values. Rows of ``asks``
    stand in no tree; they are linked to one value of each group of their shard that they are near to.
    """
    tree = np.flatnonzero(~asks) if asks is not None else np.arange(len(values))
    names, own = np.unique(shard[tree], return_inverse=True)
    forest = BKForest(values[tree], own)
    starts = np.searchsorted(own, np.arange(len(names)))
    ends = np.append(starts[1:], len(tree))
    label = np.arange(len(tree))
    at, waiting = starts.copy(), np.zeros(0, np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        idle = np.ones(len(names), bool)
        idle[own[waiting]] = False
        idle &= at < ends
        idle = np.flatnonzero(idle)
        while len(gone := idle[~forest.left[at[idle]]]):
            at[gone] += 1
            idle = idle[at[idle] < ends[idle]]
        asking = np.concatenate((waiting, at[idle]))
        if not len(asking):
            break
        forest.take_out(at[idle])
        fresh = [np.zeros(0, np.int64)]
        for part in _slices(np.maximum(forest.under[starts[own[asking]]], 1), STEPS):
            who = asking[part]
            who = who[forest.under[starts[own[who]]] > 0]
            node, by = forest.search(forest.values[who], starts[own[who]], radius)
            node, first = np.unique(node, return_index=True)
            by = who[by[first]]
            label[node] = label[by]
            forest.take_out(node)
            left.append(node)
            right.append(by)
            fresh.append(node)
        waiting = np.concatenate(fresh)
    a, b = tree[np.concatenate(left)], tree[np.concatenate(right)]
    if asks is not None and asks.any():
        forest.fill()
        lo, hi = label.copy(), label.copy()
        for level in forest.levels[:0:-1]:
            np.minimum.at(lo, forest.above[level], lo[level])
            np.maximum.at(hi, forest.above[level], hi[level])
        uniform = np.where(lo == hi, lo, -1)
        who = np.flatnonzero(asks)
        of = np.searchsorted(names, shard[who])
        has = of < len(names)
        who, of = who[has], of[has]
        who, of = who[names[of] == shard[who]], of[names[of] == shard[who]]
        for part in _slices(forest.under[starts[of]], STEPS):
            node, by = forest.search(values[who[part]], starts[of[part]], radius, label, uniform)
            pair = np.unique(by * len(tree) + label[node])
            a = np.concatenate((a, who[part][pair // len(tree)]))
            b = np.concatenate((b, tree[pair % len(tree)]))
    return a, b, forest


def block_masks(radius: int, keep: int) -> list[int]:
    """Masks over 64 bits of every ``keep`` of ``radius + keep`` blocks: values within the radius agree
    on at least one of them."""
    blocks = radius + keep
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(((1 << bounds[b + 1]) - (1 << bounds[b])) for b in c) for c in combinations(range(blocks), keep)]


def blocks_kept(n: int, radius: int) -> int:
    """How many blocks name a shard, so that evenly spread fingerprints fill one with ``SHARD`` at most."""
    keep = 1
    while keep < 8 and n / 2.0 ** (64 * keep // (radius + keep)) > SHARD:
        keep += 1
    return keep


def keyed_by_blocks(fps: DataFrame, radius: int, keep: int) -> DataFrame:
    """``_c, _key, _fp``: the shards of 64-bit fingerprints, without loss for the radius."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, keep)]
    return fps.select("_fp", F.posexplode(F.array(*(F.col("_fp").bitwiseAND(F.lit(m)) for m in masks))).alias("_c", "_key")).select("_c", "_key", "_fp")


def keyed_by_samples(fps: DataFrame, tables: range, bits: int = KEY_BITS, words64: int = WIDE) -> DataFrame:
    """``_c, _key, _fp, _g``: in each table a fixed random choice of ``bits`` bits names the shard. ``_g``, null
    if ``fps`` has none, is the group that a fingerprint is known to belong to."""
    rng = np.random.default_rng(SEED)
    picks = np.stack([rng.permutation(64 * words64)[:bits] for _ in range(tables.stop)])[tables.start :]
    kind = fps.schema["_fp"].dataType.simpleString()
    f = fps.select("_fp", F.col("_g") if "_g" in fps.columns else F.lit(None).cast(kind).alias("_g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                v = _values(b.column(0))
                every = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(len(v), -1), axis=1, bitorder="little")
                key = (every[:, picks].astype(np.int64) << np.arange(bits)).sum(axis=2)
                row = pa.array(np.repeat(np.arange(len(v)), len(picks)))
                c = np.tile(np.arange(tables.start, tables.stop, dtype=np.int32), len(v))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(key.ravel()), b.column(0).take(row), b.column(1).take(row)], names=["_c", "_key", "_fp", "_g"])

    return f.mapInArrow(run, f"_c int, _key long, _fp {kind}, _g {kind}")


def dealt_in_parts(keyed: DataFrame, fewer: DataFrame, part: int, one_of: int) -> DataFrame:
    """``keyed`` with ``_block`` and ``_asks``. A shard is one tree; one of more than about ``part`` values
    becomes several, each in blocks of its own: a block holds one part as the tree and one that asks.

    How large shards are is told by ``fewer``, the keyed rows of one fingerprint in ``one_of``. It says
    only how work is dealt out: links are the same whatever it says.
    """
    hot = fewer.groupBy("_c", "_key").agg(F.ceil(F.count(F.lit(1)) * F.lit(float(one_of)) / part).cast("int").alias("_parts")).filter("_parts > 1")
    hot = materialise(hot, "hot")
    d = keyed.join(hot, ["_c", "_key"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    d = d.withColumn("_part", F.pmod(F.xxhash64("_fp", F.lit(SEED)), F.col("_parts")).cast("int"))
    place = F.expr("transform(sequence(0, _parts - 1), k -> struct(least(k, _part) * _parts + greatest(k, _part) as b, k < _part as a))")
    d = d.withColumn("_at", F.explode(place))
    return d.select(*keyed.columns, F.col("_at.b").alias("_block"), F.col("_at.a").alias("_asks"))


def shard_links(keyed: DataFrame, fewer: DataFrame, radius: int, part: int | None = None, one_of: int = SAMPLE) -> DataFrame:
    """Links ``_a, _b`` that span, shard by shard, the groups of all distinct ``_fp`` within the radius.
    Every shard is searched through its BK-tree. Two of one known group (``_g``) need no link."""
    kind = keyed.schema["_fp"].dataType.simpleString()
    grouped = "_g" in keyed.columns
    cols = ["_c", "_key", "_block", "_asks", "_fp", *(["_g"] if grouped else [])]
    dealt = dealt_in_parts(keyed, fewer, part or PART, one_of).select(*cols)
    dealt = dealt.repartition("_c", "_key", "_block").sortWithinPartitions("_c", "_key", "_block", "_asks", "_fp")

    def links(b: pa.RecordBatch, shard: np.ndarray) -> pa.RecordBatch:
        asks = b.column(3).to_numpy(zero_copy_only=False)
        left, right, _ = forest_links(_values(b.column(4)), shard, radius, asks if asks.any() else None)
        a, c = pa.array(left), pa.array(right)
        if grouped and len(a):
            g = b.column(5)
            apart = pc.fill_null(pc.not_equal(g.take(a), g.take(c)), True)
            a, c = a.filter(apart), c.filter(apart)
        return pa.RecordBatch.from_arrays([b.column(4).take(a), b.column(4).take(c)], names=["_a", "_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the shard that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            ends = [[b.column(i)[j].as_py() for i in (0, 1, 2)] for j in (0, b.num_rows - 1)]
            going_on = bool(held) and [held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in (0, 1, 2)] == ends[0] == ends[1]
            held.append(b)
            if going_on:
                continue
            whole = pa.concat_batches(held)
            keys = np.column_stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)])
            change = np.concatenate(([0], (keys[1:] != keys[:-1]).any(axis=1).cumsum()))
            start = int(np.searchsorted(change, change[-1]))
            held = [whole.slice(start)]
            if start:
                yield links(whole.slice(0, start), change[:start])
        if held:
            whole = pa.concat_batches(held)
            yield links(whole, np.zeros(whole.num_rows, np.int64))

    return dealt.mapInArrow(run, f"_a {kind}, _b {kind}")


def sampled(fps: DataFrame, one_of: int = SAMPLE) -> DataFrame:
    return fps.filter(F.pmod(F.xxhash64("_fp"), F.lit(one_of)) == 0)


def components(links: DataFrame) -> DataFrame:
    """``_node, _root``: nodes of one component share a root; nodes without links are left out.

    In each round a node moves to its smallest neighbour, in an order that a hash makes random, and
    the links between the places moved to are the next round's: these shrink geometrically. Every
    round is written to the shared folder; the driver sees only whether links are left.
    """
    e = materialise(links.select(F.col("_a").alias("_u"), F.col("_b").alias("_v")).union(links.select("_b", "_a")).distinct(), "links")
    root = None
    while root is None or not e.isEmpty():
        order = F.struct(F.xxhash64("_v").alias("h"), F.col("_v").alias("v"))
        own = F.struct(F.xxhash64("_u").alias("h"), F.col("_u").alias("v"))
        moved = materialise(e.groupBy("_u").agg(F.min(order).alias("_m")).select(F.col("_u").alias("_node"), F.least(own, "_m")["v"].alias("_root")), "moves")
        a, b = moved.toDF("_u", "_ru"), moved.toDF("_v", "_rv")
        e = materialise(e.join(a, "_u").join(b, "_v").filter("_ru <> _rv").select(F.col("_ru").alias("_u"), F.col("_rv").alias("_v")).distinct(), "links")
        root = moved if root is None else root.join(moved.toDF("_root", "_next"), "_root", "left").select("_node", F.coalesce("_next", "_root").alias("_root"))
    return root


def _with_least(rows: DataFrame, least: str) -> DataFrame:
    """``rows`` with ``_group``, the smallest ``least`` of its ``_root``."""
    of = materialise(rows.groupBy("_root").agg(F.min(least).alias("_group"), F.count(F.lit(1)).alias("_n")), "least")
    return join_counted(rows, of, "_root", "_n")


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, _th, _fp, _group, _root`` for every row: rows whose 64-bit fingerprints differ in at most
    ``radius`` bits are linked, and ``_group`` is the smallest id reachable over links, the row itself
    included. ``_root`` tells groups apart where ids are null or repeated. No link is lost.

    Null and empty texts, and texts of blanks, have fingerprint 0 and link like any other; fewer words
    than ``shingle`` are one shingle. Repeated rows are linked (distance 0). A null id is never the
    smallest unless its group has no other. An empty table gives an empty table.

    Equal fingerprints become one row before the search, so copies cost nothing there.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialise(rows.groupBy("_fp").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_n")), "distinct")
    keep = blocks_kept(fps.count(), radius)
    links = shard_links(keyed_by_blocks(fps, radius, keep), keyed_by_blocks(sampled(fps), radius, keep), radius)
    roots = materialise(components(links), "roots")
    of = fps.join(roots, fps["_fp"] == roots["_node"], "left").select("_fp", "_least", "_n", F.coalesce("_root", "_fp").alias("_root"))
    of = materialise(_with_least(materialise(of, "rooted"), "_least").drop("_least"), "grouped")
    return join_counted(rows, of, "_fp", "_n").select(id_col, "_th", "_fp", "_group", "_root")


def radius_of(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of two texts differ at most, if that share of all their shingles is
    common: the expected number for texts of one length, and three standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """The columns of ``wanted`` and ``_set``, the distinct shingles, once for each ``_th`` of ``wanted``."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = [i for i, h in enumerate(b.column(0).to_pylist()) if h not in seen and not seen.add(h)]
            yield b.take(pa.array(new, pa.int64()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in once(batches):
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                found = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "_set"])

    d = docs.select(F.xxhash64(text_col).alias("_th"), F.col(text_col).cast("binary").alias("_text"))
    # Copies go before the shuffle, so that one text in many rows is no hot key.
    d = d.mapInArrow(once, d.schema).join(wanted, "_th").select("_th", *(c for c in wanted.columns if c != "_th"), "_text").repartition("_th")
    return d.mapInArrow(sets, d.drop("_text").withColumn("_set", F.array(F.lit(0).cast("long"))).schema)


def resembling(sets: DataFrame, similarity: float) -> DataFrame:
    """``_th, _label``: texts of one ``_near`` group share a label if they are joined by pairs of which the
    exact resemblance of the sets is at least ``similarity``. Two empty sets are alike.

    In each round some texts of a group are pivots and are compared with all that are not yet in their
    component; then they are done. A group is finished when all that is left has one label: any two
    of its texts were compared, or known as joined. A small group takes one round, a large group of
    near copies a few, with work in proportion to its size. Texts already joined to others are drawn
    apart from the rest, since what they were joined by may join more.
    """
    state = materialise(sets.select("_near", "_th", F.col("_th").alias("_label"), F.lit(False).alias("_hit"), F.lit(True).alias("_open")), "labels")
    pivots = PIVOTS
    while True:
        left = state.filter("_open")
        parts = left.groupBy("_near").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_hit").alias("_hits"), F.min("_label").alias("_lo"), F.max("_label").alias("_hi"))
        parts = materialise(parts.filter("_lo <> _hi").drop("_lo", "_hi"), "parts")
        if parts.isEmpty():
            return state.select("_th", "_label")
        draw = F.pmod(F.xxhash64("_th", F.lit(pivots)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chance = F.lit(float(pivots)) / F.when(F.col("_hit"), F.col("_hits")).otherwise(F.col("_n") - F.col("_hits"))
        turn = left.join(parts, "_near").select("_near", "_th", "_label", (draw < chance).alias("_pivot"), F.ceil(F.col("_n") / PART_ROWS).alias("_parts"))
        turn = materialise(turn, "turn")
        full = turn.join(sets.select("_th", "_set"), "_th")
        p = full.filter("_pivot").select("_near", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.col("_th").alias("_pth"), F.col("_label").alias("_plabel"), F.col("_set").alias("_pset"))
        x = full.select("_near", F.pmod(F.xxhash64("_th"), F.col("_parts")).alias("_part"), "_th", "_label", "_pivot", "_set")
        sizes = [F.size("_set"), F.size("_pset")]
        pairs = x.join(p, ["_near", "_part"]).filter((F.col("_label") != F.col("_plabel")) & (~F.col("_pivot") | (F.col("_th") < F.col("_pth"))) & (F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-6))
        both = F.size(F.array_intersect("_set", "_pset"))
        alike = (F.greatest(*sizes) == 0) | (both / (sizes[0] + sizes[1] - both) >= similarity)
        moves = components(materialise(pairs.filter(alike).select(F.col("_label").alias("_a"), F.col("_plabel").alias("_b")).distinct(), "alike"))
        state = state.join(turn.filter("_pivot").select("_th", F.lit(True).alias("_done")), "_th", "left").join(moves, F.col("_label") == F.col("_node"), "left")
        open_ = F.col("_open") & F.col("_done").isNull()
        state = materialise(state.select("_near", "_th", F.coalesce("_root", "_label").alias("_label"), (F.col("_hit") | F.col("_root").isNotNull()).alias("_hit"), open_.alias("_open")), "labels")
        pivots *= 2


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``similar_roots`` with ``_group``, the smallest id of each root."""
    return _with_least(similar_roots(docs, similarity, shingle, id_col, text_col), id_col).select(id_col, "_th", "_fp", "_group", "_root")


def similar_roots(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, _th, _fp, _root`` for every row: texts are linked whose resemblance, the share of
    their distinct shingles that both have, is at least ``similarity``; groups of linked ones share a
    ``_root``. Every link is confirmed on the shingles themselves.

    Fingerprints only say which texts to compare. A resemblance of 0.8 moves about a seventh of the
    bits, too many to tell with 64 of them: these have 256 bits, of distinct shingles, and ``radius_of``
    says how many may differ. Shards are named by bits from ``TABLES`` fixed choices. A pair at the limit can be missed if its
    texts meet in no shard and are not joined by others; those of 0.9 meet with over 0.999. A first
    round over few tables finds most of the large groups, whose members then need no links among
    themselves in the second.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, WIDE, distinct=True), "fingerprints")
    texts = materialise(rows.select("_th", "_fp").distinct(), "texts")
    fps = materialise(texts.select("_fp").distinct(), "distinct")
    radius = radius_of(similarity, 64 * WIDE)
    some = range(FIRST_TABLES), range(FIRST_TABLES, TABLES)
    first = materialise(shard_links(keyed_by_samples(fps, some[0]), keyed_by_samples(sampled(fps), some[0]), radius), "first")
    known = materialise(components(first), "known")
    fps_known = fps.join(known.select(F.col("_node").alias("_fp"), F.col("_root").alias("_g")), "_fp", "left")
    second = shard_links(keyed_by_samples(fps_known, some[1]), keyed_by_samples(sampled(fps), some[1]), radius)
    # A known group counts by the links of its members to its root.
    links = materialise(known.select(F.col("_node").alias("_a"), F.col("_root").alias("_b")).union(second), "candidates")
    near = texts.join(components(links), F.col("_fp") == F.col("_node"), "left").select("_th", F.coalesce("_root", "_fp").alias("_near"))
    near = materialise(near, "near")
    shared = near.groupBy("_near").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    sets = materialise(shingle_sets(docs, near.join(shared, "_near"), shingle, text_col), "sets")
    labels = resembling(sets, similarity)
    copies = rows.groupBy("_th").agg(F.count(F.lit(1)).alias("_n"))
    of = materialise(copies.join(labels, "_th", "left").select("_th", "_n", F.coalesce("_label", "_th").alias("_root")), "roots")
    return materialise(join_counted(rows, of, "_th", "_n").select(id_col, "_th", "_fp", "_root"), "found")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, a null id only where the group has no
    other; where rows share that id, the text with the smallest hash. Rows equal in id and text stay
    together. Groups are told apart by ``_root``: each keeps its own row, whatever ids others have."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_th").alias("th")))
    stay = groups.groupBy("_root").agg(first.alias("_k")).select(F.col("_k.id").alias("_kid"), F.col("_k.th").alias("_kth"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    i, t = (d[names[docs.columns.index(c)]] for c in (id_col, text_col))
    return d.join(stay, i.eqNullSafe(stay["_kid"]) & (F.xxhash64(t) == stay["_kth"]), "left_semi").toDF(*docs.columns)

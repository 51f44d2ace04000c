"""Routes between many pairs of nodes of a road network of any size, through an overlay of cells.

The network is cut into cells of a quadtree with a bounded number of nodes. Inside each cell the distances between its
border nodes are found once; together with the roads between cells they make jumps from where a cell is entered
to where the next one is, stored as a table. A query searches the cells of its ends, one task for each cell, and
follows jumps as joins in between, round by round. No task holds more than one cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.scratch import materialise

#: Nodes of a cell at most, unless it is of the finest level; degrees of the coarsest cells; levels below them.
MOST_NODES, COARSEST, LEVELS = 2000, 4.0, 15
#: Level of the cells by which nodes are dealt, some 14 km high: cells below it are counted where the nodes are.
DEALT = 5
#: Nodes of a task that counts these, some: each has a row for every level there. Without a number the plan would make as many tasks as cores.
TASK_NODES = 100_000
#: Places that were reached in a round are sent to every task up to this number (some 10 MB), so that jumps stay where they are.
MOST_SENT = 400_000


@dataclass
class Overlay:
    """``cells``: node_id, cell; ``inside``: cell, from_node, to_node, length_m of roads within cells;
    ``cross``: from_node, to_node, length_m, cell and to_cell of roads between them; ``jumps``: from_node, to_node, metres."""

    cells: DataFrame
    inside: DataFrame
    cross: DataFrame
    jumps: DataFrame


def cells_of(nodes: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """``node_id, cell`` for nodes with ``lat`` and ``lng``: the largest cell of the quadtree that has no more than
    ``most`` nodes. Nodes move once, to cells of the level ``DEALT``: larger cells are found on the counts of these, smaller
    ones among the nodes of each."""
    fine = COARSEST / (1 << LEVELS)
    up = lambda c, k, of: F.floor(F.col(c) / F.pow(F.lit(2.0), of - k))
    at = nodes.select("node_id", F.floor(F.col("lat") / fine).alias("_y"), F.floor(F.col("lng") / fine).alias("_x"))
    at = at.withColumns({"_dy": up("_y", F.lit(DEALT), LEVELS), "_dx": up("_x", F.lit(DEALT), LEVELS)})

    def large(n: DataFrame) -> DataFrame:
        k = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT))).alias("_k")).withColumns({"_cy": up("_dy", F.col("_k"), DEALT), "_cx": up("_dx", F.col("_k"), DEALT)})
        sums = k.groupBy("_k", "_cy", "_cx").agg(F.sum("_n").alias("_all")).filter(F.col("_all") <= most)
        return n.select("_dy", "_dx").join(k.join(sums, ["_k", "_cy", "_cx"]).groupBy("_dy", "_dx").agg(_largest()), ["_dy", "_dx"], "left")

    counts = materialise(at.groupBy("_dy", "_dx").agg(F.count(F.lit(1)).alias("_n")), "counts")
    tasks = 1 + (counts.agg(F.sum("_n")).first()[0] or 0) // TASK_NODES
    at = at.repartition(tasks, "_dy", "_dx").join(materialise(large(counts), "large"), ["_dy", "_dx"])
    levels = at.select("*", F.explode(F.when(F.col("_c").isNull(), F.sequence(F.lit(DEALT + 1), F.lit(LEVELS))).otherwise(F.array("_c._k"))).alias("_k"))
    levels = levels.withColumns({"_cy": up("_y", F.col("_k"), LEVELS), "_cx": up("_x", F.col("_k"), LEVELS)})
    levels = levels.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("_dy", "_dx", "_k", "_cy", "_cx")))
    leaf = levels.filter((F.col("_all") <= most) | (F.col("_k") == LEVELS)).groupBy("_dy", "_dx", "node_id").agg(_largest())
    return leaf.select("node_id", F.concat_ws("/", "_c._k", "_c._cy", "_c._cx").alias("cell"))


def _largest() -> Column:
    return F.min(F.struct("_k", "_cy", "_cx")).alias("_c")


def _search(out: dict[int, list[tuple[int, float]]], first: int, wanted: set[int] | None = None) -> dict[int, float]:
    """Metres from a node to those that can be reached in its cell; ends once all wanted ones are settled."""
    best, heap, done = {first: 0.0}, [(0.0, first)], set()
    left = None if wanted is None else set(wanted)
    while heap and left != set():
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        if left is not None:
            left.discard(n)
        for m, w in out.get(n, ()):
            if d + w < best.get(m, float("inf")):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return {n: best[n] for n in done}


def _graph(t: pa.Table, back: bool = False) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(t.column("from_node").to_pylist(), t.column("to_node").to_pylist(), t.column("length_m").to_pylist(), strict=True):
        a, b = (b, a) if back else (a, b)
        out.setdefault(a, []).append((b, w))
    return out


def _triples(rows: Iterable[tuple[int, int, int, float]]) -> pa.Table:
    kind, a, b, m = zip(*rows, strict=True) if (rows := list(rows)) else ((),) * 4
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "metres": pa.array(m, pa.float64())})


#: Kinds of questions to a cell: from a node to the cell's exits, from its entries to a node, from one node to another.
EXITS, ENTRIES, DIRECT = 0, 1, 2


def _ask(inside: DataFrame, borders: DataFrame, questions: DataFrame) -> DataFrame:
    """``kind, a, b, metres`` for ``questions`` (cell, kind, a, b): one task for each cell that is asked.

    ``borders``: cell, node, exit (whether a road leaves there) and entry. A node without a road has distance 0 from itself.
    """

    def fn(key, q: pa.Table, more: pa.Table) -> pa.Table:
        roads_ = more.filter(pc.is_valid(more.column("from_node")))
        border = more.filter(pc.is_valid(more.column("node")))
        out, back = _graph(roads_), _graph(roads_, True)
        pick = lambda c: {n for n, x in zip(border.column("node").to_pylist(), border.column(c).to_pylist(), strict=True) if x}
        exits, entries = pick("exit"), pick("entry")
        asked: dict[tuple[int, int], set[int]] = {}
        for kind, a, b in zip(*(q.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
            asked.setdefault((kind, a), set()).add(b)
        rows: list[tuple[int, int, int, float]] = []
        for (kind, a), others in asked.items():
            wanted = {EXITS: exits, ENTRIES: entries, DIRECT: others}[kind]
            found = _search(back if kind == ENTRIES else out, a, wanted)
            rows += [(kind, n, a, found[n]) if kind == ENTRIES else (kind, a, n, found[n]) for n in wanted if n in found]
        return _triples(rows)

    cell = inside.select("cell", "from_node", "to_node", "length_m", *(F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("exit", "boolean"), ("entry", "boolean"))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("from_node", "long"), ("to_node", "long"), ("length_m", "double"))]
    cell = cell.unionByName(borders.select("cell", *none, "node", "exit", "entry"))
    asked = questions.select(F.col("cell").alias("cell"), "kind", "a", "b")
    return asked.groupBy("cell").cogroup(cell.join(asked.select("cell").distinct(), "cell", "left_semi").groupBy("cell")).applyInArrow(fn, "kind int, a long, b long, metres double")


def _borders(cross: DataFrame) -> DataFrame:
    """``cell, node, exit, entry`` of the ends of roads between cells."""
    both = cross.select("cell", F.col("from_node").alias("node"), F.lit(True).alias("exit"), F.lit(False).alias("entry"))
    both = both.unionByName(cross.select(F.col("to_cell").alias("cell"), F.col("to_node").alias("node"), F.lit(False).alias("exit"), F.lit(True).alias("entry")))
    return both.groupBy("cell", "node").agg(F.max("exit").alias("exit"), F.max("entry").alias("entry"))


def build(edges: DataFrame, most: int = MOST_NODES) -> Overlay:
    """The overlay of finished ``edges``; its tables are written once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("start_node").alias("node_id"), F.col("lat1").alias("lat"), F.col("lng1").alias("lng")), F.struct(F.col("end_node").alias("node_id"), F.col("lat2").alias("lat"), F.col("lng2").alias("lng")))).alias("p"))
    nodes = ends.groupBy(F.col("p.node_id").alias("node_id")).agg(F.min("p.lat").alias("lat"), F.min("p.lng").alias("lng"))
    cells = materialise(cells_of(nodes, most), "cells")
    of = lambda n, c: cells.select(F.col("node_id").alias(n), F.col("cell").alias(c))
    placed = edges.join(of("start_node", "_a"), "start_node").join(of("end_node", "_b"), "end_node")
    arc = lambda a, b, m, n: F.struct(F.col(m).alias("cell"), F.col(n).alias("to_cell"), F.col(a).alias("from_node"), F.col(b).alias("to_node"), "length_m")
    ahead, back = arc("start_node", "end_node", "_a", "_b"), arc("end_node", "start_node", "_b", "_a")
    arcs = materialise(placed.select(F.inline(F.when(F.col("one_way"), F.array(ahead)).otherwise(F.array(ahead, back)))), "arcs")
    inside, cross = arcs.filter("cell = to_cell").drop("to_cell"), arcs.filter("cell <> to_cell")
    borders = materialise(_borders(cross), "borders")
    asked = borders.filter("entry").select("cell", F.lit(EXITS).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"))
    through = _ask(inside, borders, asked)
    jumps = through.join(cross.select(F.col("from_node").alias("b"), "to_node", "length_m"), "b").groupBy(F.col("a").alias("from_node"), "to_node").agg(F.min(F.col("metres") + F.col("length_m")).alias("metres"))
    return Overlay(cells, inside, cross, materialise(jumps, "jumps"))


def metres_between(overlay: Overlay, pairs: DataFrame, most_m: float | None = None) -> DataFrame:
    """``source, target, metres`` of distinct pairs of nodes: the length of the shortest way, null where there is none (or
    none of up to ``most_m``). A node unknown to the network has no way; one to itself is 0.

    Each round takes the jumps from all places that were reached nearer than before, as one join; a source goes
    on only as far as its farthest target needs. Rounds become small long before the last one: then their places go to
    the tables, and of these only what a place meets is moved.
    """
    asked = materialise(pairs.select("source", "target").filter("source is not null and target is not null").distinct(), "pairs")
    of = lambda c: overlay.cells.select(F.col("node_id").alias(c), F.col("cell").alias(f"_{c}"))
    known = materialise(asked.join(of("source"), "source").join(of("target"), "target"), "asked")
    none = F.lit(None).cast("long").alias("b")
    q = known.select(F.col("_source").alias("cell"), F.lit(EXITS).alias("kind"), F.col("source").alias("a"), none).distinct()
    q = q.unionByName(known.select(F.col("_target").alias("cell"), F.lit(ENTRIES).alias("kind"), F.col("target").alias("a"), none).distinct())
    q = q.unionByName(known.filter("_source = _target").select(F.col("_source").alias("cell"), F.lit(DIRECT).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))
    found = materialise(_ask(overlay.inside, _borders(overlay.cross), q), "answers")
    arrive = found.filter(F.col("kind") == ENTRIES).select(F.col("a").alias("node"), F.col("b").alias("target"), F.col("metres").alias("_last"))
    limit = F.lit(float("inf") if most_m is None else most_m)
    best = found.filter(F.col("kind") == DIRECT).select(F.col("a").alias("source"), F.col("b").alias("target"), "metres").filter(F.col("metres") <= limit)
    nearest = lambda d, *by: d.groupBy(*by).agg(F.min("metres").alias("metres"))
    first = found.filter(F.col("kind") == EXITS).join(overlay.cross.select(F.col("from_node").alias("b"), F.col("to_node").alias("node"), "length_m"), "b")
    new = nearest(first.select(F.col("a").alias("source"), "node", (F.col("metres") + F.col("length_m")).alias("metres")), "source", "node")
    new = reached = materialise(new.filter(F.col("metres") <= limit), "reached")
    jumps = overlay.jumps.select(F.col("from_node").alias("node"), "to_node", F.col("metres").alias("_m"))
    while n := new.count():
        few = F.broadcast if n <= MOST_SENT else lambda d: d
        mine = known.select("source", "target").join(few(new.select("source")), "source", "left_semi")
        at_target = few(new).join(arrive, "node").select("source", "target", (F.col("metres") + F.col("_last")).alias("metres")).filter(F.col("metres") <= limit)
        best = best.unionByName(materialise(nearest(at_target.join(mine, ["source", "target"], "left_semi"), "source", "target"), "best"))
        so_far = nearest(best.join(few(new.select("source")), "source", "left_semi"), "source", "target")
        needs = mine.join(so_far, ["source", "target"], "left").groupBy("source").agg(F.max(F.coalesce("metres", limit)).alias("_far"))
        go = few(new.join(needs, "source").filter(F.col("metres") < F.col("_far")))
        step = go.join(jumps, "node").select("source", F.col("to_node").alias("node"), (F.col("metres") + F.col("_m")).alias("metres"), "_far")
        step = materialise(nearest(step.filter(F.col("metres") < F.col("_far")), "source", "node"), "step")
        before = nearest(reached.join(step.select("source", "node"), ["source", "node"], "left_semi"), "source", "node").withColumnRenamed("metres", "_before")
        new = materialise(step.join(before, ["source", "node"], "left").filter(F.col("_before").isNull() | (F.col("metres") < F.col("_before"))).select("source", "node", "metres"), "new")
        reached = reached.unionByName(new)
    return asked.join(nearest(best, "source", "target"), ["source", "target"], "left").select("source", "target", "metres")

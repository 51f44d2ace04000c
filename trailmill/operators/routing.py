"""Routes between places on roads, for the roads of one region."""

from __future__ import annotations

import heapq
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions import arrays
from trailmill.functions.text import FAST, UNNAMED
from trailmill.params import DEFAULTS, MatchParams
from trailmill.scratch import materialise

FIELDS = ("edge_id", "way_id", "start_node", "end_node", "lat1", "lng1", "lat2", "lng2", "name", "type", "one_way", "layer", "bridge", "tunnel", "ramp", "length_m", "direction", "node_degree")
FAR = 1_000_000.0


class RoadGraph:
    """Edges as arrays, and shortest paths with a memory of earlier ones."""

    MEMORY = 20_000

    def __init__(self, columns: dict[str, np.ndarray]):
        first = np.unique(columns["edge_id"], return_index=True)[1]
        self.c = c = {k: v[first] for k, v in columns.items()}
        self.index = {int(e): i for i, e in enumerate(c["edge_id"])}
        self.names = np.array(["" if n is None or n.strip() in ("", UNNAMED) else n.strip() for n in c["name"]], dtype=object)
        self.fast = c["ramp"].astype(bool) | np.isin(c["type"].astype(str), list(FAST))
        self.structure = (c["layer"] > 0) | c["bridge"].astype(bool) | c["tunnel"].astype(bool)
        self.at: dict[int, tuple[float, float]] = {}
        self.next: dict[int, dict[int, float]] = {}
        self.by_ends: dict[tuple[int, int], int] = {}
        ends = (c[k].tolist() for k in ("start_node", "end_node", "lat1", "lng1", "lat2", "lng2", "length_m", "one_way"))
        for i, (s, e, a, b, x, y, m, one) in enumerate(zip(*ends, strict=True)):
            self.at[s], self.at[e] = (a, b), (x, y)
            for n, o in ((s, e),) if one else ((s, e), (e, s)):
                out = self.next.setdefault(n, {})
                out[o] = min(m, out.get(o, m))
                self.by_ends.setdefault((n, o), i)
        self.trees: OrderedDict[int, tuple[dict, dict, list, set]] = OrderedDict()

    def _search(self, a: int, targets: set[int]) -> tuple[dict[int, float], dict[int, int]]:
        """(metres, node before) from ``a``, settled for all of ``targets`` that can be reached. A search
        goes on where the last one from the same node stopped."""
        if a not in self.trees:
            self.trees[a] = ({a: 0.0}, {}, [(0.0, a)], set())
            if len(self.trees) > self.MEMORY:
                self.trees.popitem(last=False)
        self.trees.move_to_end(a)
        best, before, heap, done = self.trees[a]
        left = targets - done
        while heap and left:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            left.discard(n)
            for m, w in self.next.get(n, {}).items():
                if d + w < best.get(m, float("inf")):
                    best[m], before[m] = d + w, n
                    heapq.heappush(heap, (d + w, m))
        return best, before

    def metres(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the shortest paths between pairs of nodes, infinite where there is none: one
        search for each distinct first node, and one look for each distinct pair."""
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        pairs, back = np.unique(at[: len(a)] * len(nodes) + at[len(a) :], return_inverse=True)
        a, b = nodes[pairs // max(len(nodes), 1)], nodes[pairs % max(len(nodes), 1)]
        out = np.full(len(a), np.inf)
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
            targets = b[part].tolist()
            best, _ = self._search(int(a[part[0]]), set(targets))
            out[part] = [best.get(t, np.inf) for t in targets]
        return out[back]

    def path(self, a: int, b: int) -> tuple[float, list[int]] | None:
        """(metres, nodes) of the shortest path."""
        best, before = self._search(a, {b})
        if b not in best:
            return None
        nodes = [b]
        while nodes[-1] != a:
            nodes.append(before[nodes[-1]])
        return best[b], nodes[::-1]

    def gap(self, a: int, b: int) -> float:
        return 0.0 if a == b else float(arrays.haversine(*self.at[a], *self.at[b]))

    def share_node(self, i, j):
        s, e = self.c["start_node"], self.c["end_node"]
        return (s[i] == s[j]) | (s[i] == e[j]) | (e[i] == s[j]) | (e[i] == e[j])

    def end_gaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Metres between the ends of two edges: start to start, start to end, end to start, end to end."""
        c = self.c
        ends = ("start_node", "lat1", "lng1"), ("end_node", "lat2", "lng2")
        return np.stack([np.where(c[n][i] == c[m][j], 0.0, arrays.haversine(c[a][i], c[b][i], c[x][j], c[y][j])) for n, a, b in ends for m, x, y in ends])

    def continues(self, i, j, angle: float):
        """Of one way, of one name and both fast, or nearly of one direction."""
        c = self.c
        named = (self.names[i] == self.names[j]) & (self.names[i] != "") & self.fast[i] & self.fast[j]
        return (c["way_id"][i] == c["way_id"][j]) | named.astype(bool) | (arrays.angle_difference(c["direction"][i], c["direction"][j]) <= angle)

    def _places(self, i, offset):
        """(metres to the start, metres to the end) of places on edges."""
        length = np.maximum(self.c["length_m"][i], 1.0)
        o = np.clip(offset, 0.0, length)
        return o, length - o

    def ways(self, i: np.ndarray, oi: np.ndarray, j: np.ndarray, oj: np.ndarray, p: MatchParams = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
        """(metres, kind) of the best ways from places on edges to places on others; infinite where there
        is none. Kinds 0 to 3 go along the graph, 4 to 7 are handed over directly where edges go on from
        one another: by start or end (2) of the first and start or end (1) of the second."""
        c = self.c
        out, reach = self._places(i, oi), self._places(j, oj)
        nodes = (c["start_node"], c["end_node"])
        same, strong = c["way_id"][i] == c["way_id"][j], self.continues(i, j, p.corridor_angle)
        most = np.where(same | strong, p.same_way_handoff_m, np.where(self.share_node(i, j), p.handoff_m, -1.0))
        gaps, totals = self.end_gaps(i, j), np.full((8, len(i)), np.inf)
        for a in (0, 1):
            for b in (0, 1):
                # A one-way edge is left by its end and reached by its start.
                open_ = ~((a == 0) & c["one_way"][i].astype(bool)) & ~((b == 1) & c["one_way"][j].astype(bool))
                at = np.flatnonzero(open_)
                k = 2 * a + b
                cost = out[a] + reach[b]
                totals[k, at] = cost[at] + self.metres(nodes[a][i[at]], nodes[b][j[at]])
                near = open_ & (gaps[k] <= most)
                handed = (cost + gaps[k]) * np.where(strong & (gaps[k] <= p.same_way_handoff_m), p.handoff_share, 1.0)
                totals[4 + k] = np.where(near, handed, np.inf)
        kind = totals.argmin(axis=0)
        return totals[kind, np.arange(len(i))], kind

    def way(self, i: int, oi: float, j: int, oj: float, p: MatchParams = DEFAULTS) -> tuple[float, list[int]] | None:
        """(metres, nodes) of one of these ways."""
        metres, kind = (x[0] for x in self.ways(*(np.array([x]) for x in (i, oi, j, oj)), p))
        if not np.isfinite(metres):
            return None
        return float(metres), self.nodes(int(kind), i, j)

    def nodes(self, kind: int, i: int, j: int) -> list[int]:
        """Nodes of a way of this kind between two edges."""
        a, b = (int(self.c[("start_node", "end_node")[k]][e]) for k, e in ((kind % 4 // 2, i), (kind % 2, j)))
        return self.path(a, b)[1] if kind < 4 else [a] if a == b else [a, b]

    def edge_path(self, i: int, j: int) -> list[int]:
        """The edges along the shortest of the paths between an end of one road and a different end of
        another; the road itself for one and the same, none where there is no path."""
        if i == j:
            return [i]
        ends = lambda e: (int(self.c["start_node"][e]), int(self.c["end_node"][e]))
        found = [way for a in ends(i) for b in ends(j) if a != b and (way := self.path(a, b))]
        if not found:
            return []
        nodes = min(found, key=lambda w: w[0])[1]
        return [self.by_ends[n] for n in zip(nodes[:-1], nodes[1:], strict=True)]

    def road_distance(self, i: int, j: int) -> float:
        """Metres along these edges; ten times the straight distance of the middles of the roads, at
        least 100 km, where there are none. A road is 0 from itself."""
        if i == j:
            return 0.0
        c, edges = self.c, self.edge_path(i, j)
        if edges:
            return float(c["length_m"][edges].sum())
        mid = lambda e: ((c["lat1"][e] + c["lat2"][e]) / 2, (c["lng1"][e] + c["lng2"][e]) / 2)
        return max(10.0 * float(arrays.haversine(*mid(i), *mid(j))), 100_000.0)


def hop_distances(adjacency: DataFrame, source: int, most_hops: int) -> DataFrame:
    """``node, metres``: shortest distances from a node over at most ``most_hops`` edges, relaxed round by
    round as joins; for graphs of any size. Each round reads one row for each node reached."""
    spark, adjacency = adjacency.sparkSession, materialise(adjacency, "adjacency")
    reached = spark.createDataFrame([(source, 0.0)], "node long, metres double")
    for _ in range(most_hops):
        step = reached.join(adjacency, reached["node"] == adjacency["from_node"]).select(F.col("to_node").alias("node"), (F.col("metres") + F.col("length_m")).alias("metres"))
        reached = materialise(reached.unionAll(step).groupBy("node").agg(F.min("metres").alias("metres")), "reached")
    return reached

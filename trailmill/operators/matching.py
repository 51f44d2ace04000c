"""Map matching: candidates by joins and windows, the choice among them by a hidden Markov model.

Stays are drawn together first. Simple stretches take a first-order model over candidates, complex
ones a second-order model over pairs of candidates. Both run where Spark has brought the candidates
of a region together with its roads.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import arrays, geo
from trailmill.operators import motion, roads
from trailmill.operators.grouped import Group
from trailmill.operators.regions import map_with_roads
from trailmill.operators.routing import FAR, FIELDS, RoadGraph
from trailmill.params import DEFAULTS, MatchParams
from trailmill.scratch import materialise

#: By how much probabilities may differ, as a share, and yet be equal but for the last bits of angles and exponents. These
#: make some 1e-13 at most.
CLOSE = 1e-9


def likely(points: DataFrame, edges: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """For each point all edges that may be its candidates, with ``distance``, ``theta`` (-1 without a heading) and ``raw_prob``.

    An edge within the largest normal radius counts as found there; the wider search runs only for
    points without such an edge, and then edges have a penalty and a limit on the heading.
    """
    # What headings come from; without that they are taken as they are.
    source = "heading_from" if "heading_from" in points.columns else F.struct(F.col("heading_deg").alias("given"), *(F.lit(None).cast("double").alias(c) for c in ("lat0", "lng0", "lat1", "lng1"))).alias("heading_from")
    pts = materialise(points.select("trip_id", "id", "ts", "lat", "lng", "heading_deg", source), "points")  # read three times
    edges = edges.select("edge_id", "lat1", "lng1", "lat2", "lng2", "one_way", "direction")
    normal = materialise(roads.within(pts, edges, max(p.radii)).withColumn("_wide", F.lit(False)), "near")
    alone = pts.join(normal.select("id").distinct(), "id", "left_anti").select(*pts.columns)
    far = materialise(roads.within(alone, edges, max(p.fallback_radii)).withColumn("_wide", F.lit(True)), "near")
    near = normal.unionByName(far)
    theta = F.when(F.col("heading_deg").isNull(), -1.0).otherwise(geo.heading_to_road("heading_deg", "direction", "one_way"))
    near = near.withColumn("theta", theta).withColumn("distance", F.col("pr.distance"))
    plain = F.greatest(geo.gaussian("distance", p.sigma_distance) * F.when(F.col("theta") < 0, 1.0).otherwise(geo.gaussian("theta", p.sigma_heading)), F.lit(p.least_prob))
    near = near.filter(~F.col("_wide") | (F.col("theta") < 0) | (F.col("distance") <= p.complexity_radius) | (F.col("theta") <= p.fallback_heading))
    return near.withColumn("raw_prob", plain * F.when(F.col("_wide"), p.fallback_penalty).otherwise(1.0))


def candidates(points: DataFrame, edges: DataFrame, most: int, p: MatchParams = DEFAULTS) -> DataFrame:
    """For each point its ``most`` likeliest edges: ``trip_id, id, ts, lat, lng, rank, edge_id, p_lat, p_lng,
    distance, theta`` (-1 without a heading), ``offset, direction, raw_prob, prob`` (of a sum of 1).

    Where two edges meet and a point is nearest to both, their probabilities may be equal but for the last bits of sines and
    exponents, which the JVM and other engines round in ways of their own. Points with such a close call among their first
    edges are few; theirs are ranked by the values of the C library, headings included if points have ``heading_from``
    (see ``clean.fill_heading_and_speed``).
    """
    near = likely(points, edges, p)
    close = materialise(_close_calls(near, most), "close")
    called = near.join(close, "id", "left_semi").select(*near.columns).withColumn("_exact", _exact(p)(*_CALL))
    called = called.select(*near.columns, F.col("_exact.raw_prob").alias("_prob"), F.col("_exact.distance").alias("_distance"))
    plain = near.join(close, "id", "left_anti").select(*near.columns, F.col("raw_prob").alias("_prob"), F.col("distance").alias("_distance"))
    by_rank = Window.partitionBy("id").orderBy(F.desc("_prob"), "_distance", "edge_id")
    near = plain.unionByName(called).withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= most)
    return near.select("trip_id", "id", "ts", "lat", "lng", "rank", "edge_id", F.col("pr.lat").alias("p_lat"), F.col("pr.lng").alias("p_lng"), "distance", "theta", F.col("pr.offset").alias("offset"), "direction", "raw_prob", _share(p).alias("prob"))


def _close_calls(near: DataFrame, most: int) -> DataFrame:
    """``id`` of points of whose ``most`` likeliest edges one is as likely as the next, or nearly so."""
    by_prob = Window.partitionBy("id").orderBy(F.desc("raw_prob"))
    n = near.select("id", "raw_prob").withColumns({"_row": F.row_number().over(by_prob), "_last": F.lag("raw_prob").over(by_prob)})
    return n.filter((F.col("_row") <= most + 1) & (F.col("raw_prob") >= F.col("_last") * (1.0 - CLOSE))).select("id").distinct()


def _bearing(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    p1, p2, d = math.radians(lat1), math.radians(lat2), math.radians(lng2 - lng1)
    b = math.degrees(math.atan2(math.sin(d) * math.cos(p2), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * math.cos(d)))
    return b + 360.0 if b < 0 else b


def _heading(lat: float, lng: float, source: dict) -> float | None:
    """As ``clean.fill_heading_and_speed`` has it."""
    given, before, after = source["given"], (source["lat0"], source["lng0"]), (source["lat1"], source["lng1"])
    if given is None or given < 0:
        if None not in before and arrays.metres(*before, lat, lng) >= 3.0:
            return _bearing(*before, lat, lng)
        if None not in after and arrays.metres(lat, lng, *after) >= 3.0:
            return _bearing(lat, lng, *after)
    return given


def _by_c(lat, lng, source, lat1, lng1, lat2, lng2, one_way, wide, p: MatchParams) -> tuple[float, float]:
    """``raw_prob`` and ``distance`` of a point and an edge by the C library, in the order of operations of the formulas."""
    east = math.cos(math.radians((lat + lat1 + lat2) / 3.0)) * geo.DEGREE_M
    dx, dy = (lng2 - lng1) * east, (lat2 - lat1) * geo.DEGREE_M
    px, py = (lng - lng1) * east, (lat - lat1) * geo.DEGREE_M
    size = dx * dx + dy * dy
    if size > 0:
        t = max(0.0, min(1.0, (px * dx + py * dy) / size))
        distance = math.sqrt(math.pow(px - t * dx, 2) + math.pow(py - t * dy, 2))
    else:
        distance = arrays.metres(lat, lng, lat1, lng1)
    prob = math.exp(-0.5 * math.pow(distance / p.sigma_distance, 2)) / (p.sigma_distance * math.sqrt(2 * math.pi))
    heading = _heading(lat, lng, source)
    if heading is not None:
        direction = _bearing(lat1, lng1, lat2, lng2)
        apart = lambda d: min(a := math.fmod(abs(heading - d), 360.0), 360.0 - a) if math.isfinite(heading) else math.nan
        theta = apart(direction) if one_way else min(apart(direction), apart(math.fmod(direction + 180.0, 360.0)))
        prob *= math.exp(-0.5 * math.pow(theta / p.sigma_heading, 2)) / (p.sigma_heading * math.sqrt(2 * math.pi))
    return max(prob, p.least_prob) * (p.fallback_penalty if wide else 1.0), distance


#: What these values come from.
_CALL = ("lat", "lng", "heading_from", "lat1", "lng1", "lat2", "lng2", "one_way", "_wide")


def _exact(p: MatchParams):
    @F.arrow_udf("struct<raw_prob: double, distance: double>")
    def exact(lat: pa.Array, lng: pa.Array, source: pa.Array, lat1: pa.Array, lng1: pa.Array, lat2: pa.Array, lng2: pa.Array, one_way: pa.Array, wide: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (lat, lng, source, lat1, lng1, lat2, lng2, one_way, wide)), strict=True)
        return pa.array([dict(zip(("raw_prob", "distance"), _by_c(*x, p), strict=True)) for x in rows], pa.struct([("raw_prob", pa.float64()), ("distance", pa.float64())]))

    return exact


def _share(p: MatchParams) -> Column:
    """The probability of a candidate among those of its point."""
    raw = F.greatest(F.col("raw_prob"), F.lit(p.least_prob))
    return raw / F.sum(raw).over(Window.partitionBy("id"))


class _Moves:
    """Candidates of consecutive points, in stretches, and what is to be said of moves between them.

    Rows are candidates by stretch, time and rank; ``first`` and ``last`` bound the rows of each point. All moves of a
    part of a region are worked out at once, and kept as tables of one width: by point, its candidates and those of
    the next (of the one after that in ``far_family``). ``valid`` tells a point's candidates from what fills up its row.
    """

    def __init__(self, g: Group, graph: RoadGraph, p: MatchParams):
        self.g, self.graph, self.p = g, graph, p
        point = np.concatenate(([True], (g["id"][1:] != g["id"][:-1]) | (g["stretch"][1:] != g["stretch"][:-1])))
        self.first = np.flatnonzero(point)
        self.last = np.append(self.first[1:], len(point))
        stretch = g["stretch"][self.first]
        starts = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
        self.starts, self.ends = starts, np.append(starts[1:], len(stretch))
        self.edge = np.array([-1 if np.isnan(e) else graph.index.get(int(e), -1) for e in g["edge_id"].astype(float)], np.int64)
        lat, lng = g["lat"][self.first], g["lng"][self.first]
        self.steps = np.append(arrays.haversine(lat[:-1], lng[:-1], lat[1:], lng[1:]), 0.0)  # to the next point
        follows = np.append(stretch[1:] == stretch[:-1], False)
        whole = np.logical_and.reduceat(self.edge >= 0, self.first)
        self.whole = whole
        t = np.flatnonzero(follows & whole & np.append(whole[1:], False))
        a, b = self._pairs(t, t + 1)
        step = np.repeat(self.steps[t], self._sizes(t) * self._sizes(t + 1))
        self.route = self._routes(a, b)
        same = graph.structure[self.edge[a]] == graph.structure[self.edge[b]]
        turn = self._turn(a, b)
        family = self._family(a, b, turn)
        evidence = self._evidence(a, b, step)
        rates, least = p.change_rates, p.least_factors
        changed = family & ~same
        factor = np.where(changed, np.maximum(least[0], np.exp(-rates[0] * (1.0 - evidence))), 1.0)
        reward = np.where(changed, factor, np.where(family, np.minimum(1.0 + p.stay_reward, 1.0 + p.stay_reward * evidence), 1.0))
        move = np.exp(-np.abs(step - self.route) / p.route_beta) * np.exp(-p.angle_lambda * turn / 180.0)
        move = np.maximum(move * factor, p.least_prob)
        two = t[np.isin(t + 1, t)]
        c, d = self._pairs(two, two + 2)
        far = self._family(c, d, self._turn(c, d))
        self.width = int(self._sizes(slice(None)).max())
        self.valid = np.arange(self.width) < self._sizes(slice(None))[:, None]
        self.prob = np.where(self.valid, g["prob"][np.minimum(self.first[:, None] + np.arange(self.width), len(point) - 1)], 0.0)
        table = lambda v: self._table(v, t, t + 1)
        self.route, self.same, self.family, self.evidence, self.reward, self.move = map(table, (self.route, same, family, evidence, reward, move))
        self.far_family = self._table(far, two, two + 2)

    def _sizes(self, t):
        return self.last[t] - self.first[t]

    def _places(self, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all pairs of a candidate of point ``s`` and one of point ``t``, the first the slower: the pair of points, and
        the places of the two among the candidates of their points."""
        m, n = self._sizes(s), self._sizes(t)
        k = np.arange((m * n).sum()) - np.repeat(np.cumsum(m * n) - m * n, m * n)
        n_ = np.maximum(np.repeat(n, m * n), 1)
        return np.repeat(np.arange(len(s)), m * n), k // n_, k % n_

    def _pairs(self, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of these pairs."""
        k, i, j = self._places(s, t)
        return self.first[s][k] + i, self.first[t][k] + j

    def _table(self, values: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Values of these pairs by point ``s`` and the two places; 0 where there is no pair."""
        k, i, j = self._places(s, t)
        out = np.zeros((len(self.first), self.width, self.width), values.dtype)
        out[s[k], i, j] = values
        return out

    def _turn(self, a, b):
        d, one = self.g["direction"], self.graph.c["one_way"].astype(bool)
        best = arrays.angle_difference(d[a], d[b])
        back_a, back_b = ~one[self.edge[a]], ~one[self.edge[b]]
        best = np.where(back_b, np.minimum(best, arrays.angle_difference(d[a], d[b] + 180.0)), best)
        best = np.where(back_a, np.minimum(best, arrays.angle_difference(d[a] + 180.0, d[b])), best)
        return np.where(back_a & back_b, np.minimum(best, arrays.angle_difference(d[a] + 180.0, d[b] + 180.0)), best)

    def _routes(self, a, b):
        """Metres by road between candidates, with stand-ins where there is no way."""
        g, graph, p = self.g, self.graph, self.p
        i, j, oi, oj = self.edge[a], self.edge[b], g["offset"][a], g["offset"][b]
        length = np.maximum(graph.c["length_m"][i], 1.0)
        ahead = np.clip(oj, 0.0, length) - np.clip(oi, 0.0, length)
        along = (i == j) & ((ahead >= 0) | ~graph.c["one_way"][i].astype(bool))
        way = np.full(len(a), np.inf)
        k = np.flatnonzero(~along)
        way[k] = graph.ways(i[k], oi[k], j[k], oj[k], p)[0]
        direct = arrays.haversine(g["p_lat"][a], g["p_lng"][a], g["p_lat"][b], g["p_lng"][b])
        corridor = (direct <= p.corridor_m) & graph.continues(i, j, p.corridor_angle)
        stand_in = np.maximum(direct, np.minimum(direct * 1.25 + 8.0, np.abs(oj - oi) + 12.0))
        none = np.where(corridor, stand_in, np.where(direct <= p.hard_block, FAR, np.maximum(direct * 8.0, 800.0)))
        best = np.maximum(way, 0.0)
        long_ = corridor & (best > np.maximum(direct * 4.0, direct + 250.0))
        other = np.where(np.isinf(way), none, np.where(long_, np.minimum(best, stand_in), best))
        loop = np.where(np.isinf(way), length - ahead + 500.0, way)
        return np.where(along, np.abs(ahead), np.where(i == j, loop, other))

    def _family(self, a, b, turn):
        """Whether two candidates are on one corridor."""
        graph, c, i, j = self.graph, self.graph.c, self.edge[a], self.edge[b]
        named = (graph.names[i] == graph.names[j]) & (graph.names[i] != "")
        apart = lambda x, e: arrays.segment_projection(self.g["p_lat"][x], self.g["p_lng"][x], c["lat1"][e], c["lng1"][e], c["lat2"][e], c["lng2"][e])[0]
        beside = (c["type"][i] == c["type"][j]) & (np.maximum(apart(b, i), apart(a, j)) <= self.p.family_apart_m)
        return (turn <= self.p.family_angle) & ((c["way_id"][i] == c["way_id"][j]) | named.astype(bool) | graph.share_node(i, j) | beside.astype(bool))

    def _evidence(self, a, b, step):
        """How much speaks for a change of level between two candidates, 0 to 1."""
        g, graph, p, i, j = self.g, self.graph, self.p, self.edge[a], self.edge[b]
        clip = lambda x: np.clip(x, 0.0, 1.0)
        w, v = p.seen_weights, p.evidence_weights
        close = clip((p.seen_close_m - np.minimum(g["distance"][b], p.seen_close_m)) / p.seen_close_m)
        seen = clip(w[0] * clip(g["prob"][b]) + w[1] * close + w[2] * clip((g["prob"][b] - g["prob"][a] + 0.2) / 0.4))
        way = clip(1.0 - np.abs(step - self.route) / p.way_slack_m)
        ramp = graph.c["ramp"].astype(bool)
        ramp = ramp[i] | ramp[j]
        gap, joined = graph.end_gaps(i, j).min(axis=0), graph.share_node(i, j)
        joint, near, by_ramp = p.link_scores
        link = np.select([joined, gap <= p.joint_m, gap <= p.near_joint_m, ramp], [1.0, joint, near, by_ramp], 0.0)
        total = clip(v[0] * seen + v[1] * way + v[2] * link)
        return clip(np.where(ramp | joined | (gap <= p.joint_m), total, p.weak_access * total))


def _by_length(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Stretches by falling length, and for each step how many go on to it."""
    order = np.argsort(s - e, kind="stable")
    size = (e - s)[order]
    return s[order], e[order], np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left").tolist()


def _best_first(x: _Moves, s: np.ndarray, e: np.ndarray, pick: np.ndarray) -> None:
    """Puts into ``pick`` the likeliest candidates of stretches, from points ``s`` to ``e``; the first of equals. All
    stretches take a step together."""
    s, e, on = _by_length(s, e)
    lg = lambda v: np.log(np.maximum(v, x.p.least_prob))
    score, back = np.where(x.valid[s], lg(x.prob[s]), -np.inf), np.zeros((len(pick), x.width), np.int32)
    for k in range(1, len(on)):
        t = s[: on[k]] + k
        total = score[: len(t), :, None] + lg(x.move[t - 1]) + lg(x.prob[t])[:, None]
        back[t] = total.argmax(axis=1)
        score[: len(t)] = np.where(x.valid[t], total.max(axis=1), -np.inf)
    c = score.argmax(axis=1)
    for k in range(len(on) - 1, -1, -1):
        t = s[: on[k]] + k
        pick[t] = c[: len(t)]
        c[: len(t)] = back[t, pick[t]]


def _best_second(x: _Moves, s: np.ndarray, e: np.ndarray, pick: np.ndarray) -> None:
    """The same over pairs, for stretches of three points at least; the complexity weighs the move against what is
    seen, point by point."""
    p, g = x.p, x.g
    s, e, on = _by_length(s, e)
    least, rates, floor = p.least_prob, p.change_rates, p.least_factors
    lg = lambda v: np.log(np.maximum(v, least))
    seen = lambda t: np.maximum(x.prob[t][:, :, None] * x.prob[t + 1][:, None] * x.move[t], least)
    pairs = lambda t: x.valid[t][:, :, None] & x.valid[t + 1][:, None]
    row = np.minimum(x.first[s][:, None] + np.arange(x.width), len(g["theta"]) - 1)
    theta = g["theta"][row]
    near = np.where(x.valid[s], 1.0 / (np.maximum(g["distance"][row], 1.0) * np.where(theta < 0, 1.0, np.maximum(theta, 1.0))), 0.0)
    score = lg(near / near.sum(axis=1)[:, None])[:, :, None] + lg(seen(s)) + lg(x.reward[s])
    score, back = np.where(pairs(s), score, -np.inf), np.zeros((len(pick), x.width, x.width), np.int32)
    weight = g["complexity"][x.first]
    weight = np.where(weight > 0.0, np.minimum(weight, 1.0), 0.0)
    for k in range(2, len(on)):
        t = s[: on[k]] + k
        f = weight[t][:, None, None, None]
        ways = x.route[t - 2][:, :, :, None] + x.route[t - 1][:, None]
        base = np.exp(-np.abs((x.steps[t - 2] + x.steps[t - 1])[:, None, None, None] - ways) / p.second_beta) / p.second_beta
        both = x.family[t - 2][:, :, :, None] & x.family[t - 1][:, None]
        same1, same2 = x.same[t - 2][:, :, :, None], x.same[t - 1][:, None]
        calm = 1.0 - x.evidence[t - 1]
        factor = np.where(both & same1 & ~same2, np.maximum(floor[0], np.exp(-rates[1] * calm))[:, None], 1.0)
        back_again = both & ~same1 & ~same2 & x.far_family[t - 2][:, :, None]
        factor = np.where(back_again, np.maximum(floor[1], np.exp(-rates[2] * calm))[:, None], factor)
        factor = np.where(both & ~same1 & same2, (1.0 + p.settle_reward * (1.0 - calm))[:, None], factor)
        move = np.maximum(base * factor, least)
        total = score[: len(t), :, :, None] + lg((seen(t - 1) ** (1.0 - weight[t])[:, None, None])[:, None] * move**f)
        back[t] = total.argmax(axis=1)
        score[: len(t)] = np.where(pairs(t - 1), total.max(axis=1), -np.inf)
    b, c = np.divmod(score.reshape(len(s), x.width**2).argmax(axis=1), x.width)
    for k in range(len(on) - 1, 1, -1):
        t = s[: on[k]] + k
        pick[t] = c[: len(t)]
        b[: len(t)], c[: len(t)] = back[t, b[: len(t)], c[: len(t)]], b[: len(t)].copy()
    pick[s + 1], pick[s] = c, b


def _matched_part(left: pa.Table, right: pa.Table, names: list[str], p: MatchParams) -> pa.Table:
    """The chosen candidates of a part of a region: ``names`` are the columns of ``match_representatives``."""
    if not left.num_rows:
        return pa.table({c: [] for c in names})
    left = left.sort_by([("trip_id", "ascending"), ("segment", "ascending"), ("ts", "ascending"), ("id", "ascending"), ("rank", "ascending")])
    g = {c: left.column(c).to_numpy() for c in left.column_names}
    change = (g["trip_id"][1:] != g["trip_id"][:-1]) | (g["segment"][1:] != g["segment"][:-1])
    g["stretch"] = np.concatenate(([0], np.cumsum(change)))
    graph = RoadGraph({c: right.column(c).to_numpy() for c in FIELDS})
    x = _Moves(g, graph, p)
    pick = np.zeros(len(x.first), np.int64)
    whole = np.logical_and.reduceat(x.whole, x.starts)
    pairs = whole & (x.ends - x.starts > 2) & g["second"][x.first[x.starts]].astype(bool)
    for best, which in ((_best_first, whole & ~pairs), (_best_second, pairs)):
        if which.any():
            best(x, x.starts[which], x.ends[which], pick)
    i = x.first + pick
    edge = x.edge[i]
    lost = edge < 0
    own = lambda a, b: np.where(lost, b, a)
    road = np.array([None if v else graph.c["name"][k] for v, k in zip(lost, edge, strict=True)], dtype=object)
    columns = (g["trip_id"][i], g["id"][i], pa.array([None if v else int(graph.c["edge_id"][k]) for v, k in zip(lost, edge, strict=True)], pa.int64()), pa.array(road, pa.string()), own(g["p_lat"][i], g["lat"][i]), own(g["p_lng"][i], g["lng"][i]), pa.array(g["offset"][i], pa.float64(), mask=lost), own(g["prob"][i], 0.1), g["complex_segment"][i].astype(bool))
    return pa.table(dict(zip(names, columns, strict=True)))


def match_representatives(points: DataFrame, edges: DataFrame, p: MatchParams = DEFAULTS, order: str = "adaptive") -> DataFrame:
    """``trip_id, id, edge_id, road, m_lat, m_lng, m_offset, confidence, complex`` of points that are each
    matched for themselves, as stretches of one order."""
    shape = roads.complexity(points, edges, p.complexity_radius, p.complex_degree).select("trip_id", "id", "complexity", "complex_segment", "segment")
    if order != "adaptive":
        shape = shape.withColumns({"complex_segment": F.lit(order == "second"), "segment": F.lit(0)})
    shape = shape.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("trip_id", "segment"))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("trip_id")))
    cand = candidates(points, edges, p.top_complex, p).drop("trip_id", "ts", "lat", "lng", "prob")
    rows = points.select("trip_id", "id", "ts", "lat", "lng").join(shape, ["trip_id", "id"]).join(cand, "id", "left")
    # A point alone in its trip is taken as it is; a complex stretch of fewer than three is a simple one.
    second = F.col("complex_segment") & (F.col("_n") >= 3)
    rows = rows.filter(F.col("rank").isNull() | second | (F.col("rank") <= p.top_simple)).withColumn("edge_id", F.when(F.col("_all") > 1, F.col("edge_id")))
    rows = rows.withColumn("prob", _share(p)).withColumn("second", second).drop("_n", "_all", "raw_prob")

    schema = "trip_id long, id long, edge_id long, road string, m_lat double, m_lng double, m_offset double, confidence double, complex boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return map_with_roads(rows, points, edges, lambda a, b: _matched_part(a, b, names, p), schema, p)


def match(points: DataFrame, edges: DataFrame, p: MatchParams = DEFAULTS, order: str = "adaptive") -> DataFrame:
    """``trip_id, id, ts, lat, lng, edge_id, road, m_lat, m_lng, m_offset, snap_m, confidence, complex``.

    ``points`` are cleaned, with headings; ``edges`` are finished. Stays are drawn together first: their
    middle points stand for them, and what is found for these holds for all their members. ``order`` is
    first, second or adaptive: by the complexity around each point, in stretches. A stretch with a
    point without candidates takes each point's best one; such a point itself, and one that is all of
    its trip, keeps its place at a confidence of 0.1.
    """
    points, edges = materialise(points, "points"), materialise(edges, "edges")
    windows = materialise(motion.stay_members(points, p), "windows")
    middle = windows.filter("middle").select("id")
    reps = materialise(points.join(middle, "id", "left_semi").select(*points.columns), "representatives")
    found = match_representatives(reps, edges, p, order)
    by_window = windows.filter("middle").select("trip_id", "id", "window").join(found, ["trip_id", "id"]).drop("id")
    members = points.select("trip_id", "id", "ts", "lat", "lng").join(windows.select("trip_id", "id", "window"), ["trip_id", "id"])
    out = members.join(by_window, ["trip_id", "window"]).withColumn("snap_m", geo.haversine("lat", "lng", "m_lat", "m_lng"))
    cols = ("trip_id", "id", "ts", "lat", "lng", "edge_id", "road", "m_lat", "m_lng", "m_offset", "snap_m", "confidence", "complex")
    return materialise(out.select(*cols), "matched")


def _ways(g: Group, graph: RoadGraph, p: MatchParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places from each matched point to the next one of its trip, all of a part together: (point, number among the
    places of this way, latitude, longitude) in order."""
    edge = np.array([-1 if np.isnan(e) else graph.index.get(int(e), -1) for e in g["edge_id"]], np.int64)
    lat, lng, offset = g["m_lat"], g["m_lng"], g["m_offset"]
    i = np.flatnonzero(g["trip_id"][1:] == g["trip_id"][:-1])
    e, f, oe, of = edge[i], edge[i + 1], offset[i], offset[i + 1]
    direct = arrays.haversine(lat[i], lng[i], lat[i + 1], lng[i + 1])
    one_way = np.zeros(len(i), bool)
    one_way[e >= 0] = graph.c["one_way"][e[e >= 0]].astype(bool)  # there may be no road at all
    steps = np.where((e >= 0) & (e == f) & ~(one_way & (of < oe)), p.same_road_steps, p.line_steps)
    routed = np.flatnonzero((e >= 0) & (f >= 0) & (e != f))
    metres, kind = graph.ways(e[routed], oe[routed], f[routed], of[routed], p)
    limit = np.maximum(direct[routed] * p.detour_ratio, direct[routed] + p.detour_extra)
    good = np.isfinite(metres) & (metres <= limit)
    by_nodes = {k: n for k, w in zip(routed[good].tolist(), kind[good].tolist(), strict=True) if len(n := graph.nodes(w, int(e[k]), int(f[k]))) <= p.most_nodes}
    straight = np.setdiff1d(np.arange(len(i)), np.fromiter(by_nodes, np.int64, len(by_nodes)))
    point, at, la, ln = _straight(lat, lng, i[straight], steps[straight])
    # Places nearer than the least step to the last kept one are left out; mostly there are none.
    kept = [np.array([(lat[i[k]], lng[i[k]]), *(graph.at[n] for n in nodes), (lat[i[k] + 1], lng[i[k] + 1])]) for k, nodes in by_nodes.items()]
    if kept:
        flat = np.concatenate(kept)
        close = arrays.haversine(flat[:-1, 0], flat[:-1, 1], flat[1:, 0], flat[1:, 1]) < p.least_step_m
        ends = np.cumsum([len(x) for x in kept])
        for k, (s, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if close[s : z - 1].any():
                kept[k] = _spaced(kept[k], p.least_step_m)
        n = np.array([len(x) for x in kept])
        flat = np.concatenate(kept)
        point = np.concatenate((point, np.repeat(i[list(by_nodes)], n)))
        at = np.concatenate((at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
        la, ln = np.concatenate((la, flat[:, 0])), np.concatenate((ln, flat[:, 1]))
    order = np.lexsort((at, point))
    return point[order], at[order], la[order], ln[order]


def _straight(lat: np.ndarray, lng: np.ndarray, i: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of straight lines from points ``i`` to the next ones."""
    n = steps + 1
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, steps = np.repeat(i, n), np.repeat(steps, n)
    return a, k, lat[a] + (lat[a + 1] - lat[a]) * k / steps, lng[a] + (lng[a + 1] - lng[a]) * k / steps


def _spaced(places: np.ndarray, least_m: float) -> np.ndarray:
    out = [places[0]]
    for q in places[1:]:
        if arrays.haversine(*out[-1], *q) >= least_m:
            out.append(q)
    return np.array(out)


def _rebuilt_part(left: pa.Table, right: pa.Table, p: MatchParams) -> pa.Table:
    """The ways of the trips of a part of a region."""
    left = left.sort_by([("trip_id", "ascending"), ("ts", "ascending"), ("id", "ascending")])
    g = {c: left.column(c).to_numpy() for c in left.column_names}
    g["edge_id"], g["m_offset"] = g["edge_id"].astype(float), g["m_offset"].astype(float)
    graph = RoadGraph({c: right.column(c).to_numpy() for c in FIELDS})
    trip, ts = g["trip_id"], g["ts"]
    new = np.append(True, trip[1:] != trip[:-1])[: len(trip)]
    alone = np.flatnonzero(new & np.append(new[1:], True)[: len(trip)])
    point, k, lat, lng = _ways(g, graph, p)
    size = np.bincount(point, minlength=len(trip))[point]
    took = np.maximum(ts[np.minimum(point + 1, len(ts) - 1)] - ts[point], 1)
    at = ts[point] + (took * (k / np.maximum(size - 1, 1))).astype(np.int64)
    first = (k > 0) | new[point]  # a way begins where the last one ended
    columns = (np.concatenate((own, x[first])) for own, x in ((trip[alone], trip[point]), (ts[alone], at), (g["m_lat"][alone], lat), (g["m_lng"][alone], lng)))
    trip, ts, lat, lng = columns
    order = np.argsort(trip, kind="stable")
    trip, ts, lat, lng = trip[order], ts[order], lat[order], lng[order]
    seen: set[tuple] = set()
    once = np.zeros(len(trip), bool)
    for i, key in enumerate(zip(trip.tolist(), map("{:.6f}".format, lat.tolist()), map("{:.6f}".format, lng.tolist()), (ts // 1000).tolist(), strict=True)):
        if key not in seen:
            seen.add(key)
            once[i] = True
    trip, ts, lat, lng = trip[once], ts[once], lat[once], lng[once]
    begin = np.flatnonzero(np.append(True, trip[1:] != trip[:-1])[: len(trip)])
    pos = np.arange(len(trip)) - np.repeat(begin, np.diff(np.append(begin, len(trip))))
    return pa.table({"trip_id": pa.array(trip, pa.int64()), "pos": pa.array(pos, pa.int32()), "ts": pa.array(ts, pa.int64()), "lat": pa.array(lat, pa.float64()), "lng": pa.array(lng, pa.float64())})


def reconstruct(matched: DataFrame, edges: DataFrame, p: MatchParams = DEFAULTS) -> DataFrame:
    """``trip_id, pos, ts, lat, lng``: the way between matched points, over nodes where the graph gives a
    reasonable one, else a straight line. Points equal in six decimals and second are given once. A
    trip of one point is that point."""
    rows = matched.select("trip_id", "id", "ts", "edge_id", "m_lat", "m_lng", "m_offset")
    return map_with_roads(rows, matched, edges, lambda a, b: _rebuilt_part(a, b, p), "trip_id long, pos int, ts long, lat double, lng double", p)


def quality(matched: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A row for each trip: mean and upper snap distance, share of bad ones, detour, score, and whether
    the match is so poor that the raw track would be better."""
    along = lambda d, lat, lng, *o: d.withColumn("_s", geo.haversine(F.lag(lat).over(Window.partitionBy("trip_id").orderBy(*o)), F.lag(lng).over(Window.partitionBy("trip_id").orderBy(*o)), lat, lng))
    m = along(matched, "lat", "lng", "ts", "id").groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("points"), F.avg("snap_m").alias("avg_snap"), F.array_sort(F.collect_list("snap_m")).alias("_d"), F.avg((F.col("snap_m") > 30.0).cast("int")).alias("bad_ratio"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("raw_m")
    )
    r = along(rebuilt, "lat", "lng", "pos").groupBy("trip_id").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("road_m"))
    q = m.join(r, "trip_id", "left").fillna(0.0, ["road_m"])
    q = q.withColumn("p90_snap", F.get("_d", F.least(F.size("_d") - 1, F.floor(F.size("_d") * 0.9).cast("int")))).drop("_d")
    q = q.withColumn("detour_ratio", F.when(F.col("raw_m") <= 1.0, 1.0).otherwise(F.col("road_m") / F.col("raw_m"))).withColumn("detour_m", F.col("road_m") - F.col("raw_m"))
    score = F.col("avg_snap") + 0.5 * F.col("p90_snap") + 80.0 * F.col("bad_ratio") + 120.0 * F.greatest(F.lit(0.0), F.col("detour_ratio") - 1.0)
    poor = (F.col("avg_snap") > 22.0) | (F.col("p90_snap") > 38.0) | (F.col("bad_ratio") > 0.3) | ((F.col("detour_ratio") > 1.45) & (F.col("detour_m") > 220.0))
    return q.withColumn("score", score).withColumn("poor", poor)

"""Map matching in plain Python, point by point and pair by pair, for small tracks and graphs.

Edges are dicts of the columns of finished edges; points are dicts with trip_id, id, ts, lat, lng,
heading_deg and speed_mps. Written from the rules, with scalars alone, to be compared with the engine.
"""

from __future__ import annotations

import math
from itertools import combinations

R, DEG, LEAST, FAR = 6_371_000.0, 111_320.0, 1e-12, 1_000_000.0
FAST = {"motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link"}


def dist(a, b, c, d):
    s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def angle(a, b):
    d = abs(a - b) % 360
    return 360 - d if d > 180 else d


def clip(x):
    return min(1.0, max(0.0, x))


def project(lat, lng, e):
    east = math.cos(math.radians((lat + e["lat1"] + e["lat2"]) / 3)) * DEG
    dx, dy, px, py = (e["lng2"] - e["lng1"]) * east, (e["lat2"] - e["lat1"]) * DEG, (lng - e["lng1"]) * east, (lat - e["lat1"]) * DEG
    t = clip((px * dx + py * dy) / (dx * dx + dy * dy))
    return {"d": math.hypot(px - t * dx, py - t * dy), "off": math.hypot(dx, dy) * t, "lat": e["lat1"] + t * (e["lat2"] - e["lat1"]), "lng": e["lng1"] + t * (e["lng2"] - e["lng1"])}


def name_of(e):
    n = (e["name"] or "").strip()
    return "" if n == "未命名道路" else n


class Plain:
    def __init__(self, edges):
        self.edges = edges
        self.at, self.arcs = {}, {}
        for e in edges:
            s, t = e["start_node"], e["end_node"]
            self.at[s], self.at[t] = (e["lat1"], e["lng1"]), (e["lat2"], e["lng2"])
            for a, b in ((s, t),) if e["one_way"] else ((s, t), (t, s)):
                self.arcs[a, b] = min(e["length_m"], self.arcs.get((a, b), math.inf))

    def shortest(self, a):
        """Distances and paths from a node, by relaxation until nothing changes."""
        best = {a: (0.0, [a])}
        while True:
            changed = False
            for (x, y), m in self.arcs.items():
                if x in best and best[x][0] + m < best.get(y, (math.inf,))[0] - 1e-9:
                    best[y] = (best[x][0] + m, [*best[x][1], y])
                    changed = True
            if not changed:
                return best

    def candidates(self, p, most):
        def rated(e, wide):
            q = project(p["lat"], p["lng"], e)
            h = p["heading_deg"]
            theta = -1.0 if h is None else angle(h, e["direction"]) if e["one_way"] else min(angle(h, e["direction"]), angle(h, (e["direction"] + 180) % 360))
            obs = math.exp(-0.5 * (q["d"] / 20) ** 2) / (20 * math.sqrt(2 * math.pi))
            if theta >= 0:
                obs *= math.exp(-0.5 * (theta / 45) ** 2) / (45 * math.sqrt(2 * math.pi))
            return {"e": e, **q, "theta": theta, "obs": max(obs, LEAST) * (0.72 if wide else 1.0)}

        found = [c for e in self.edges if (c := rated(e, False))["d"] <= 120]
        if not found:
            found = [c for e in self.edges if (c := rated(e, True))["d"] <= 260 and not (c["theta"] >= 0 and c["d"] > 40 and c["theta"] > 35)]
        found = sorted(found, key=lambda c: (-c["obs"], c["d"], c["e"]["edge_id"]))[:most]
        total = sum(max(c["obs"], LEAST) for c in found)
        return [c | {"prob": max(c["obs"], LEAST) / total, "p": p} for c in found]

    @staticmethod
    def share(a, b):
        return bool({a["start_node"], a["end_node"]} & {b["start_node"], b["end_node"]})

    @staticmethod
    def turn(a, b):
        ways = lambda c: [c["e"]["direction"]] if c["e"]["one_way"] else [c["e"]["direction"], (c["e"]["direction"] + 180) % 360]
        return min(angle(x, y) for x in ways(a) for y in ways(b))

    def family(self, a, b):
        e, f = a["e"], b["e"]
        if self.turn(a, b) > 15:
            return False
        if e["way_id"] == f["way_id"] or (name_of(e) and name_of(e) == name_of(f)) or self.share(e, f):
            return True
        return e["type"] == f["type"] and max(project(b["lat"], b["lng"], e)["d"], project(a["lat"], a["lng"], f)["d"]) <= 35

    @staticmethod
    def strong(e, f):
        fast = lambda x: x["ramp"] or x["type"] in FAST
        named = name_of(e) and name_of(e) == name_of(f) and fast(e) and fast(f)
        return bool(e["way_id"] == f["way_id"] or named or angle(e["direction"], f["direction"]) <= 25)

    @staticmethod
    def exits(e, off):
        length = max(e["length_m"], 1.0)
        o = max(0.0, min(length, off))
        both = [(e["start_node"], o), (e["end_node"], length - o)]
        return (both[1:], both[:1]) if e["one_way"] else (both, both)

    def way(self, e, oe, f, of):
        outs, ins = self.exits(e, oe)[0], self.exits(f, of)[1]
        best = None
        for n, c in outs:
            reach = self.shortest(n)
            for m, k in ins:
                if m in reach and (best is None or c + reach[m][0] + k < best[0]):
                    best = (c + reach[m][0] + k, reach[m][1])
        same, strong = e["way_id"] == f["way_id"], self.strong(e, f)
        if same or strong or self.share(e, f):
            for n, c in outs:
                for m, k in ins:
                    gap = 0.0 if n == m else dist(*self.at[n], *self.at[m])
                    if gap <= (90 if same or strong else 35):
                        total = (c + gap + k) * (0.92 if strong and gap <= 90 else 1.0)
                        if best is None or total < best[0]:
                            best = (total, [n] if n == m else [n, m])
        return best

    def route(self, a, b):
        e, f = a["e"], b["e"]
        if e["edge_id"] == f["edge_id"]:
            length = max(e["length_m"], 1.0)
            d = max(0.0, min(length, b["off"])) - max(0.0, min(length, a["off"]))
            if not e["one_way"] or d >= 0:
                return abs(d)
            loop = self.way(e, a["off"], e, b["off"])
            return loop[0] if loop else length + abs(d) + 500
        direct = dist(a["lat"], a["lng"], b["lat"], b["lng"])
        corridor = direct <= 120 and self.strong(e, f)
        stand_in = max(direct, min(direct * 1.25 + 8, abs(b["off"] - a["off"]) + 12))
        best = self.way(e, a["off"], f, b["off"])
        if best is None:
            return stand_in if corridor else FAR if direct <= 120 else max(direct * 8, 800.0)
        return min(best[0], stand_in) if corridor and best[0] > max(direct * 4, direct + 250) else best[0]

    @staticmethod
    def level(c):
        return bool(c["e"]["layer"] > 0 or c["e"]["bridge"] or c["e"]["tunnel"])

    def evidence(self, a, b):
        e, f = a["e"], b["e"]
        seen = clip(0.45 * clip(b["prob"]) + 0.35 * clip((25 - min(b["d"], 25)) / 25) + 0.2 * clip((b["prob"] - a["prob"] + 0.2) / 0.4))
        way = clip(1 - abs(step(a["p"], b["p"]) - self.route(a, b)) / 40)
        gap = min(0.0 if n == m else dist(*self.at[n], *self.at[m]) for n in (e["start_node"], e["end_node"]) for m in (f["start_node"], f["end_node"]))
        ramp = e["ramp"] or f["ramp"]
        link = 1.0 if self.share(e, f) else 0.85 if gap <= 20 else 0.6 if gap <= 35 else 0.65 if ramp else 0.0
        total = clip(0.45 * seen + 0.35 * way + 0.2 * link)
        return clip(total if ramp or self.share(e, f) or gap <= 20 else total * 0.75)

    def pair_factor(self, a, b, reward):
        if not self.family(a, b):
            return 1.0
        v = self.evidence(a, b)
        if self.level(a) != self.level(b):
            return max(0.1, min(1.0, math.exp(-2.05 * (1 - v))))
        return max(1.0, min(1.18, 1 + 0.18 * v)) if reward else 1.0

    def first(self, a, b):
        m = math.exp(-abs(step(a["p"], b["p"]) - self.route(a, b)) / 100) * math.exp(-2 * self.turn(a, b) / 180)
        return max(m * self.pair_factor(a, b, False), LEAST)

    def second(self, a, b, c):
        way = self.route(a, b) + self.route(b, c)
        base = math.exp(-abs(step(a["p"], b["p"]) + step(b["p"], c["p"]) - way) / 120) / 120
        factor = 1.0
        if self.family(a, b) and self.family(b, c):
            x, y, z = map(self.level, (a, b, c))
            v = self.evidence(b, c)
            if x == y != z:
                factor = max(0.1, min(1.0, math.exp(-2.1 * (1 - v))))
            elif x != y and y != z and self.family(a, c):
                factor = max(0.03, min(1.0, math.exp(-3.2 * (1 - v))))
            elif x != y == z:
                factor = max(1.0, min(1.75, 1 + 0.75 * v))
        return max(base * factor, LEAST)

    def best(self, layers, complexity=None):
        """The sequence of largest score: all are tried, the first of equals stays."""
        lg = lambda v: math.log(max(v, LEAST))
        two = complexity is not None and len(layers) >= 3
        near = [1 / (max(c["d"], 1) * (1 if c["theta"] < 0 else max(c["theta"], 1))) for c in layers[0]]
        states = [((i,), lg(near[i] / sum(near)) if two else lg(c["prob"])) for i, c in enumerate(layers[0])]
        for t in range(1, len(layers)):
            new = {}
            for path, score in states:
                a = layers[t - 1][path[-1]]
                for k, b in enumerate(layers[t]):
                    if not two:
                        s = score + lg(self.first(a, b)) + lg(b["prob"])
                    else:
                        seen = max(a["prob"] * b["prob"] * self.first(a, b), LEAST)
                        if t == 1:
                            s = score + lg(seen) + lg(self.pair_factor(a, b, True))
                        else:
                            f = clip(complexity[t])
                            s = score + lg(seen ** (1 - f) * self.second(layers[t - 2][path[-2]], a, b) ** f)
                    key = (path[-1], k) if two else k
                    if key not in new or s > new[key][1] + 1e-12:
                        new[key] = ((*path, k), s)
            states = list(new.values())
        return max(states, key=lambda x: x[1])[0]

    def complexity(self, pts):
        raw, linked, high = [], [], []
        for p in pts:
            near = [e for e in self.edges if project(p["lat"], p["lng"], e)["d"] <= 40]
            d = [abs(min(angle(a["direction"], b["direction"]), 180 - angle(a["direction"], b["direction"]))) for a, b in combinations(near, 2)]
            raw.append(sum((x - sum(d) / len(d)) ** 2 for x in d) / len(d) if d else None)
            nodes = [n for e in near for n in (e["start_node"], e["end_node"])]
            linked.append(clip(0.5 * (1 + len(nodes) / len(set(nodes)) / len(near))) if near else 0.0)
            high.append(any(e["node_degree"] >= 4 for e in near))
        known = [v for v in raw if v is not None]
        mean = sum(known) / len(known) if known else 0.0
        sd = math.sqrt(sum((v - mean) ** 2 for v in known) / len(known)) if known else 0.0
        out = []
        for v, k in zip(raw, linked, strict=True):
            directional = 0.0 if v is None else clip(1 - 0.5 * v) if sd < 1e-9 else clip(1 - 0.5 * abs((v - mean) / sd))
            out.append(max(directional, k))
        flag = [(v is not None and 0 < v < 0.5) or h for v, h in zip(raw, high, strict=True)]
        wide = [any(flag[max(0, i - 2) : i + 3]) for i in range(len(pts))]
        return out, wide

    def match(self, pts, order="adaptive"):
        """(id, edge or None, lat, lng, confidence) of every point of a trip."""
        windows, i = [], 0
        while i < len(pts):
            end = i + 1
            while end < len(pts) and dist(pts[i]["lat"], pts[i]["lng"], pts[end]["lat"], pts[end]["lng"]) <= 12:
                end += 1
            known = [q["speed_mps"] for q in pts[i:end] if q["speed_mps"] is not None]
            slow = (sum(known) / len(known) if known else 0.0) <= 1.5
            if end - i > 1 and pts[end - 1]["ts"] - pts[i]["ts"] >= 20_000 and slow:
                windows.append(pts[i:end])
                i = end
            else:
                windows.append([pts[i]])
                i += 1
        reps = [w[len(w) // 2] for w in windows]
        raw = lambda p: (None, p["lat"], p["lng"], 0.1, None)
        if len(reps) == 1:
            found = [raw(reps[0])]
        else:
            grade, wide = self.complexity(reps)
            if order != "adaptive":
                wide = [order == "second"] * len(reps)
            found, s = [], 0
            while s < len(reps):
                e = s + 1
                while e < len(reps) and wide[e] == wide[s]:
                    e += 1
                hard = wide[s] and e - s >= 3
                layers = [self.candidates(p, 6 if hard else 4) for p in reps[s:e]]
                if all(layers):
                    at = self.best(layers, grade[s:e] if hard else None)
                else:
                    at = [0] * len(layers)
                for p, layer, k in zip(reps[s:e], layers, at, strict=True):
                    c = layer[k] if layer else None
                    found.append((c["e"]["edge_id"], c["lat"], c["lng"], clip(c["prob"]), c["off"]) if c else raw(p))
                s = e
        return [(q["id"], q["ts"], *f) for w, f in zip(windows, found, strict=True) for q in w]

    def rebuild(self, matched):
        """(ts, lat, lng) of the way between matched points."""
        by_id = {e["edge_id"]: e for e in self.edges}
        if len(matched) == 1:
            return [(matched[0][1], matched[0][3], matched[0][4])]
        line = lambda a, b, n: [a, *((a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(1, n + 1))]
        out, seen = [], set()
        for i, (x, y) in enumerate(zip(matched[:-1], matched[1:], strict=True)):
            a, b, e, f = (x[3], x[4]), (y[3], y[4]), by_id.get(x[2]), by_id.get(y[2])
            if e is None or f is None:
                pts = line(a, b, 8)
            elif e is f:
                pts = line(a, b, 8 if e["one_way"] and y[6] < x[6] else 3)
            else:
                direct, way = dist(*a, *b), self.way(e, x[6], f, y[6])
                if way is None or way[0] > max(direct * 3.2, direct + 220) or len(way[1]) > 12:
                    pts = line(a, b, 8)
                else:
                    pts = [a]
                    for q in [*(self.at[n] for n in way[1]), b]:
                        if dist(*pts[-1], *q) >= 2:
                            pts.append(q)
            took = max(y[1] - x[1], 1)
            for j in range(1 if i else 0, len(pts)):
                ts = x[1] + int(took * (j / (len(pts) - 1) if len(pts) > 1 else 0.0))
                key = (f"{pts[j][0]:.6f}", f"{pts[j][1]:.6f}", ts // 1000)
                if key not in seen:
                    seen.add(key)
                    out.append((ts, *pts[j]))
        return out


def step(p, q):
    return dist(p["lat"], p["lng"], q["lat"], q["lng"])

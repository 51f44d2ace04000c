"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def line_dedup(docs, least=3, chars=20):
    key = lambda s: s.strip(BLANKS).translate(LOW)
    held = defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= least and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def decontaminate(docs, items, window=10):
    win, sizes = defaultdict(set), set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if n and i is not None:
            sizes.add(n)
            for s in range(len(w) - n + 1):
                win[tuple(w[s : s + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in win:
                    found |= win[k]
                    hit |= set(range(s, s + n))
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


def substring_dedup(docs, window=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone |= set(range(s, s + window))
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def simhash(t, shingle=4):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    count = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(sh))


def components(fp, radius=4):
    ids = sorted(fp)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def pii(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and sum(int(c) if j % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for j, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def licenses(ids, rules):
    """Names of the rules that match, each once: rules in order take what follows one another, from the left."""
    left, out = list(ids), []
    for name, wanted in rules:
        i = 0
        while i <= len(left) - len(wanted):
            if tuple(left[i : i + len(wanted)]) == tuple(wanted):
                left[i : i + len(wanted)] = [None]
                if name not in out:
                    out.append(name)
            i += 1
    return out


def language(labelled, asked, longest=5):
    """Words by their log frequency, unseen ones by the mean of their longest known n-grams."""
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    cut = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 2 - n + 1)]
    langs = sorted({x for _, _, x in labelled})
    seen = [defaultdict(lambda: [0.5] * len(langs)) for _ in range(longest + 1)]
    for _, t, x in labelled:
        for w in split(t):
            for n in range(longest + 1):
                for f in cut(w, n) if n else [w]:
                    if f not in seen[n]:
                        seen[n][f] = [0.5] * len(langs)
                    seen[n][f][langs.index(x)] += 1
    total = [[sum(v[k] for v in s.values()) for k in range(len(langs))] for s in seen]
    log = lambda n, f: np.array([np.log(c / t) for c, t in zip(seen[n][f], total[n], strict=True)])

    def told(w):
        if w in seen[0]:
            return log(0, w)
        for n in range(longest, 0, -1):
            if known := [log(n, f) for f in cut(w, n) if f in seen[n]]:
                return sum(known) / len(known)
        return None

    out = {}
    for i, t, _ in asked:
        logs = [x for w in split(t) if (x := told(w)) is not None]
        if not logs:
            out[i] = (langs[0] if split(t) else "und", 0.0)
            continue
        best = int(np.argmax(sum(logs)))
        out[i] = (langs[best], float(np.mean([np.exp(x - x.max())[best] / np.exp(x - x.max()).sum() for x in logs])))
    return out


def ids_sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

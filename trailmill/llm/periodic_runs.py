"""Operator 13, periodic runs of words by the linear method of Gusfield and Stoye for tandem repeats.

For each stretch of words that can hold a run:

1. a suffix tree over word numbers, and from it the Lempel-Ziv blocks;
2. for each block the squares with their centre in it, by common extensions around its borders: these
   pairs of place and length cover the leftmost occurrence of every square;
3. the pairs are put on the tree from the leaves up, and walks along suffix links add every other
   square of the text, so that the tree holds the complete vocabulary;
4. the leaves below a square of primitive root are its occurrences; neighbouring ones are merged into runs.

Spark deals the texts, and a task handles the words of one Arrow batch after another. Common extensions come
from ranks of word sequences of 1, 2, 4, .. words, found with numpy for all pairs at once, which costs
a logarithm more than the constant time of the paper.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SuffixTree:
    """Suffix tree of whole numbers (none below 0), built from left to right, with suffix links.

    Node 0 is the root. Of node ``v``, ``first[v]`` and ``last[v]`` bound the text on the edge to it,
    ``depth[v]`` is the length of its path, ``least[v]`` the smallest place where that occurs, and the leaves
    below it are ``leaves[lo[v]:hi[v]]``.
    """

    def __init__(self, codes: list[int]):
        s = [*codes, -1]
        n = len(s)
        self.codes = s
        first, last, link, kids, parent = [0], [0], [0], [{}], [0]
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(s):
            waiting += 1
            before = 0
            while waiting:
                if not length:
                    edge = i
                v = kids[node].get(s[edge])
                if v is None:
                    kids[node][s[edge]] = len(first)
                    first.append(i), last.append(n), link.append(0), kids.append({}), parent.append(node)
                    if before:
                        link[before] = node
                        before = 0
                else:
                    span = min(last[v], i + 1) - first[v]
                    if length >= span:
                        edge, length, node = edge + span, length - span, v
                        continue
                    at = first[v] + length
                    if s[at] == c:
                        if before:
                            link[before] = node
                        length += 1
                        break
                    new = len(first)
                    first.append(first[v]), last.append(at), link.append(0), kids.append({s[at]: v, c: new + 1}), parent.append(node)
                    kids[node][s[edge]] = new
                    first[v], parent[v] = at, new
                    first.append(i), last.append(n), link.append(0), kids.append({}), parent.append(new)
                    if before:
                        link[before] = new
                    before = new
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.first, self.last, self.link, self.kids, self.parent = first, last, link, kids, parent
        depth, lo, order, stack = [0] * len(first), [0] * len(first), [], [0]
        leaves: list[int] = []
        while stack:
            v = stack.pop()
            order.append(v)
            lo[v] = len(leaves)
            if v:
                depth[v] = depth[parent[v]] + last[v] - first[v]
            if kids[v]:
                stack.extend(kids[v].values())
            else:
                leaves.append(n - depth[v])
        least, hi = [n] * len(first), [0] * len(first)
        for v in reversed(order):
            if not kids[v]:
                least[v], hi[v] = n - depth[v], lo[v] + 1
            p = parent[v]
            if v and least[v] < least[p]:
                least[p] = least[v]
            if v and hi[v] > hi[p]:
                hi[p] = hi[v]
        self.depth, self.order, self.leaves, self.least, self.lo, self.hi = depth, order, leaves, least, lo, hi

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks, and the end: a block is the longest prefix of the rest that
        also begins earlier, or one word."""
        s, depth, kids, least, n = self.codes, self.depth, self.kids, self.least, len(self.codes) - 1
        starts, h = [], 0
        while h < n:
            starts.append(h)
            v = 0
            while h + depth[v] < n:
                c = kids[v].get(s[h + depth[v]])
                if c is None or least[c] >= h:
                    break
                v = c
            h += max(depth[v], 1)
        return [*starts, n]

    def place(self, pairs: dict[int, list[int]]) -> dict[int, set[int]]:
        """Node below whose edge's upper end the square ends, to lengths of squares, for lists of lengths by
        place. A list goes up with the leftmost leaf alone: what is repeated further left is covered there."""
        marks: dict[int, set[int]] = {}
        wait = {i: sorted(set(x)) for i, x in pairs.items()}
        depth, parent, least = self.depth, self.parent, self.least
        for v in reversed(self.order):
            x = wait.get(least[v])
            if x:
                above = depth[parent[v]]
                while x and x[-1] > above:
                    if x[-1] <= depth[v]:
                        marks.setdefault(v, set()).add(x[-1])
                    x.pop()
        return marks

    def complete(self, marks: dict[int, set[int]]) -> dict[int, set[int]]:
        """All rotations of the marked squares that the text holds, by walks along suffix links."""
        s, depth, parent, kids, link, first = self.codes, self.depth, self.parent, self.kids, self.link, self.first
        for v, size in [(v, size) for v, sizes in marks.items() for size in sizes]:
            while True:
                # the path of v begins with the square; without its first word it ends below link[parent]
                at = first[v] - depth[parent[v]]  # a place where that path begins
                a = s[at]
                u = parent[v]
                w = link[u] if u else 0
                while depth[w] < size - 1:
                    w = kids[w][s[at + 1 + depth[w]]]
                if depth[w] == size - 1:
                    w = kids[w].get(a)
                    if w is None:
                        break
                elif s[first[w] + size - 1 - depth[parent[w]]] != a:
                    break
                have = marks.setdefault(w, set())
                if size in have:
                    break
                have.add(size)
                v = w
        return marks


class Extensions:
    """Common extensions of pairs of places, by ranks of sequences of 1, 2, 4, .. words."""

    def __init__(self, codes: np.ndarray):
        self.n, self.ranks = len(codes), [codes]
        while 2 << (len(self.ranks) - 1) <= self.n:
            r, w = self.ranks[-1], 1 << (len(self.ranks) - 1)
            key = r[:-w].astype(np.int64) * (int(r.max()) + 1) + r[w:]
            self.ranks.append(pd.factorize(key)[0])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on."""
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            r, w = self.ranks[j], 1 << j
            fits = np.flatnonzero(np.maximum(a, b) + got + w <= self.n)
            same = fits[r[a[fits] + got[fits]] == r[b[fits] + got[fits]]]
            got[same] += w
        return got

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to ``a`` equal those up to ``b``, both included."""
        got = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            r, w = self.ranks[j], 1 << j
            fits = np.flatnonzero(np.minimum(a, b) - got - w + 1 >= 0)
            same = fits[r[a[fits] - got[fits] - w + 1] == r[b[fits] - got[fits] - w + 1]]
            got[same] += w
        return got


def covering_pairs(starts: list[int], ext: Extensions, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and half length of squares, halves up to ``most``, that cover the leftmost occurrence of each."""
    h = np.array(starts[:-1])
    h1 = np.array(starts[1:])
    h2 = np.array([*starts[2:], starts[-1]])

    def counted(upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.minimum(upto, most)
        block = np.repeat(np.arange(len(upto)), upto)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(upto) - upto, upto) + 1

    # squares that begin in the block and reach beyond its end
    block, k = counted(h1 - h)
    q = h1[block] - k
    k1, k2 = ext.forward(h1[block], q), ext.backward(h1[block] - 1, q - 1)
    ok = (k1 + k2 >= k) & (k1 > 0)
    at, half = np.maximum(q - k2, q - k + 1)[ok], k[ok]
    # squares that begin before the block
    block, k = counted(h2 - h)
    ok = h[block] + k < ext.n
    block, k = block[ok], k[ok]
    b, q = h[block], h[block] + k
    k1, k2 = ext.forward(b, q), ext.backward(b - 1, q - 1)
    start = np.maximum(b - k2, b - k + 1)
    ok = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= h1[block])
    return np.concatenate([at, start[ok]]), np.concatenate([half, k[ok]])


def _primitive(at: np.ndarray, half: np.ndarray, ext: Extensions) -> np.ndarray:
    """Whether the halves are no powers: no shift by the half over a prime leaves the half as it is."""
    primes = {k: _primes(k) for k in set(half.tolist())}
    tried = [(j, k // p) for j, k in enumerate(half.tolist()) for p in primes[k]]
    ok = np.ones(len(at), bool)
    if tried:
        j, shift = np.array(tried).T
        ok[j[ext.forward(at[j], at[j] + shift) >= 2 * half[j] - shift]] = False
    return ok


def _primes(k: int) -> list[int]:
    out, p = [], 2
    while p * p <= k:
        if k % p == 0:
            out.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return out + ([k] if k > 1 else [])


def runs_of(codes: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of the runs of one sequence of word numbers, by start and period.

    Only periods that a run of that exponent can have are sought.
    """
    n, most = len(codes), len(codes) // least_exponent
    if n < max(least_length, least_exponent) or not most:
        return []
    codes = pd.factorize(codes)[0]
    tree, ext = SuffixTree(codes.tolist()), Extensions(codes)
    at, half = covering_pairs(tree.blocks(), ext, most)
    real = _primitive(at, half, ext)  # rotations of a power are powers
    pairs: dict[int, list[int]] = {}
    for i, k in zip(at[real].tolist(), half[real].tolist(), strict=True):
        pairs.setdefault(i, []).append(2 * k)
    marks = tree.complete(tree.place(pairs))
    by_period: dict[int, list[np.ndarray]] = {}
    leaves = np.array(tree.leaves)
    for v, sizes in marks.items():
        for size in sizes:
            by_period.setdefault(size // 2, []).append(leaves[tree.lo[v] : tree.hi[v]])
    found = []
    for k, places in by_period.items():
        x = np.sort(np.concatenate(places))
        new = np.flatnonzero(np.diff(x, prepend=-2) != 1)
        length = x[np.append(new[1:], len(x)) - 1] - x[new] + 2 * k
        long = length >= max(least_length, least_exponent * k)
        found += [(int(a), int(b), k) for a, b in zip(x[new][long], length[long], strict=True)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def gram(least_length: int, least_exponent: int) -> int:
    """The longest sequence of words that, wherever in a run, occurs in it a second time, one period away."""
    return max(1, min(max(least_length, least_exponent * q) - 2 * q + 1 for q in range(1, least_length + 1)))


def stretches(words: np.ndarray, doc: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of the longest stretches of all whose sequences of ``size`` words occur twice in their document.

    ``words`` holds the word numbers of several documents one after another and ``doc`` the document of each.
    Every run lies in one stretch, and is as long in it as in the document.
    """
    n = len(words)
    code, _ = pd.factorize(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
    width = 1
    while width < size and len(code):
        step = min(width, size - width)
        code, width = pd.factorize(code[:-step].astype(np.int64) * (int(code.max(initial=0)) + 1) + code[step:])[0], width + step
    if not len(code):
        return
    twice = np.bincount(code)[code] > 1
    twice &= doc[: len(code)] == doc[size - 1 :]
    at = np.flatnonzero(twice)
    inside, joins = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    inside[at] += 1
    inside[at + size] -= 1
    covered = np.cumsum(inside[:-1]) > 0
    # a word belongs to the stretch of the one before it if a sequence holds both, or if both begin one
    joins[at[at + 1 < n] + 1] += 1
    joins[at + size] -= 1
    linked = np.cumsum(joins[:-1]) > 0
    if size == 1:
        linked = np.append(False, twice[1:] & twice[:-1] & (doc[1:] == doc[:-1]))
    starts = np.flatnonzero(covered & ~linked)
    ends = np.flatnonzero(covered & ~np.append(linked[1:], False)) + 1
    yield from zip(starts.tolist(), ends.tolist(), strict=True)


def find_runs(docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """``id_cols``, ``_n_words``, ``_runs`` (array of start, length and period, by start and period) and
    ``_collapsed``, the words that no run holds after its first period, joined by spaces.

    A run is a stretch of words of smallest period ``period``, of ``least_length`` words or more and of
    ``least_exponent`` periods or more, that can't be extended. Null and empty texts have no words and no runs,
    repeated rows get equal results, null ids are kept, an empty table stays empty; other columns are left
    out, so no name clashes. Texts are handled where they are read, without a shuffle. A text is one value
    and so one task's; its tree holds only the stretches in which short sequences of words repeat
    (``stretches``), one after another.
    """
    if least_length < 2 or least_exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    size = gram(least_length, least_exponent)
    own = [f"_i{k}" for k in range(len(id_cols))]
    d = docs.select(*(F.col(c).alias(o) for c, o in zip(id_cols, own, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    runs_type = "array<struct<start:int,length:int,period:int>>"
    schema = d.drop("_text").selectExpr("*", "cast(null as long) as _n_words", f"cast(null as {runs_type}) as _runs", "cast(null as string) as _collapsed").schema
    arrow_runs = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, whole.num_columns - 1)):
            words = [WORD.findall(t) for t in b.column(b.num_columns - 1).to_pylist()]
            counts = np.array([len(w) for w in words])
            base = np.cumsum(counts) - counts
            flat = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0]
            doc = np.repeat(np.arange(len(words)), counts)
            found: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for start, end in stretches(flat, doc, size):
                i = int(doc[start])
                found[i] += [(start - int(base[i]) + s, length, p) for s, length, p in runs_of(flat[start:end], least_length, least_exponent)]
            kept = []
            for w, runs in zip(words, found, strict=True):
                runs.sort(key=lambda r: (r[0], r[2]))
                if runs:
                    gone = np.zeros(len(w), bool)
                    for s, length, p in runs:
                        gone[s + p : s + length] = True
                    w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                kept.append(" ".join(w))
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(listed, arrow_runs), pa.array(kept, pa.string())], names=[*own, "_n_words", "_runs", "_collapsed"])

    return d.mapInArrow(run, schema).toDF(*id_cols, "_n_words", "_runs", "_collapsed")


def digest(runs: list[tuple[int, int, int]]) -> str:
    """Hash of a list of runs, one line for each."""
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()

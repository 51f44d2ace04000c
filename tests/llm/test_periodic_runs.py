"""Operator 13 against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trailmill.llm import periodic_runs, queries


def plain(w, length=6, exponent=4):
    """Every maximal stretch of every period, told by its bounds once, with the smallest period."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences(count, seed=5):
    r = random.Random(seed)
    for _ in range(count):
        n = r.randint(0, 60)
        w = [r.randrange(r.choice([1, 2, 2, 3, 5])) for _ in range(n)]
        if n and r.random() < 0.5:
            w = (w[: r.randint(1, 9)] * 70)[:n]
            for _ in range(r.randint(0, 2)):
                w[r.randrange(n)] = 9
        yield w


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (3, 2), (5, 3), (12, 5)])
def test_runs_of_random_sequences(length, exponent):
    seen = 0
    for w in sequences(700):
        words = np.array(w, dtype=np.int64)
        want = plain(w, length, exponent)
        assert periodic_runs.runs_of(words, length, exponent) == want
        parts = list(periodic_runs.stretches(words, np.zeros(len(w), int), periodic_runs.gram(length, exponent)))
        got = [(s + a, n, q) for s, e in parts for a, n, q in periodic_runs.runs_of(words[s:e], length, exponent)]
        assert sorted(got, key=lambda r: (r[0], r[2])) == want
        seen += len(want)
    assert seen > 150


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs.runs_of(np.array(b), 2, 2) == plain(b, 2, 2)


def test_vocabulary_is_complete():
    """The tree holds every square of primitive root, each once."""
    for w in sequences(150, 8):
        if len(w) < 6:
            continue
        ext = periodic_runs.Extensions(np.array(w))
        tree = periodic_runs.SuffixTree(w)
        at, half = periodic_runs.covering_pairs(tree.blocks(), ext, len(w) // 2)
        pairs: dict[int, list[int]] = {}
        for i, k in zip(at.tolist(), half.tolist(), strict=True):
            assert w[i : i + k] == w[i + k : i + 2 * k]
            pairs.setdefault(i, []).append(2 * k)
        marks = tree.complete(tree.place(pairs))
        got = [tuple(w[tree.leaves[tree.lo[v]] :][:size]) for v, sizes in marks.items() for size in sizes]
        want = {tuple(w[i : i + 2 * k]) for i in range(len(w)) for k in range(1, len(w) // 2 + 1) if i + 2 * k <= len(w) and w[i : i + k] == w[i + k : i + 2 * k]}
        assert len(got) == len(set(got)) and set(got) == want


def documents():
    r = random.Random(2)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (None, "a b " * 9), (4, "a b " * 7), (5, "x " * 3000)]
    for i in range(6, 120):
        w = [r.choice(["the", "of", "bél", "on", "x1"]) + r.choice("abc") for _ in range(r.randint(1, 90))]
        docs.append((i, r.choice([" ", "\n", " \t"]).join(w * (3 if i % 4 == 0 else 1))))
    return [*docs, docs[9]]


def expected(docs):
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain(w)
        gone = {j for s, length, p in runs for j in range(s + p, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        yield (i, len(runs), *best, milli, periodic_runs.digest(runs), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())


def test_query(spark, tmp_path):
    docs = documents()
    spark.createDataFrame([(i, t, "c", "c") for i, t in docs], "doc_id long, text string, _w string, start string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(expected(docs), key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_operator_keeps_words_and_ignores_other_columns(spark):
    d = spark.createDataFrame([(1, "s a b a b a b a b e", "x", "y")], "doc_id long, text string, _runs string, _collapsed string")
    r = periodic_runs.find_runs(d).first()
    assert [tuple(x) for x in r["_runs"]] == [(1, 8, 2)] and r["_collapsed"] == "s a b e" and r["_n_words"] == 10
    assert periodic_runs.find_runs(d.limit(0)).count() == 0

"""Operator 11 against one matrix in memory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import queries, whitening


def plain(rows):
    """Whitened values by id, counts and shares, from vectors that are all usable."""
    x = (np.floor(64 * np.array([v for _, v in rows], dtype=float)) + 1_000_000).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    e, v = np.linalg.eigh(np.cov((u - s / n).T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), ((x - s / n) @ v) / np.sqrt(e), e / e.sum()


def vectors(n=300, d=20, seed=3):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) * np.linspace(2, 0.2, d)
    v[n // 3 : 2 * n // 3] = v[0]  # a third of all rows are copies
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]


SCHEMA = "vec_id long, embedding array<float>, _x string, _i0 string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA).repartition(5)


def test_query_against_one_matrix(spark, tmp_path):
    rows = vectors()
    bad = [(900, None), (901, [1.0, None] * 10), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, []), (905, [1.0])]
    frame(spark, rows + bad).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path)).toPandas()
    n, deviation, y, share = plain(rows)
    assert set(got["n"]) == {n} and n == 200 and len(got) == 16 * len(rows)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(len(rows))].to_numpy()
    signs = np.sign((table * y[:, :16]).sum(axis=0))
    assert np.abs(table * signs - y[:, :16]).max() < 1e-8
    assert (got.groupby("vec_id")["deviation"].first().to_numpy() == deviation).all()
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() - share[:16]).max() < 1e-12
    assert got["identity_error"].max() < 1e-9


def test_clashing_columns_nulls_and_repeated_rows(spark):
    rows = vectors(60, 4)
    d = frame(spark, [*rows, *rows, (None, rows[0][1])])
    out = whitening.whiten(d, whitening.fit(d, 3))
    assert out.columns == ["vec_id", "_deviation", "_whitened"] and out.count() == 121
    of_null = out.filter("vec_id is null").first()["_whitened"]
    assert len(of_null) == 3
    assert of_null == out.filter("vec_id = 0").first()["_whitened"]


def test_components_without_variance_are_null(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(a), 2 * float(a), 5.0]) for i, a in enumerate(r.integers(0, 50, 40))]
    d = frame(spark, rows)
    m = whitening.fit(d)
    out = whitening.whiten(d, m).collect()
    assert all(x["_whitened"][0] is not None and x["_whitened"][1:] == [None, None] for x in out)
    assert m.explained[0] == pytest.approx(1) and m.explained[1:].tolist() == [0, 0] and m.identity_error < 1e-9
    one = frame(spark, [(1, [1.0, 2.0])] * 3)
    assert [x["_whitened"] for x in whitening.whiten(one, whitening.fit(one)).collect()] == [[None, None]] * 3


def test_empty_table(spark, tmp_path):
    d = frame(spark, []).withColumn("embedding", F.col("embedding"))
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.fit(d) is None
    got = queries.op11_whitening(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_very_large_entries_stay_exact(spark):
    rows = [(i, [v, float(i)]) for i, v in enumerate([1e12, -1e12, 3e14, 1e300])]
    d = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[max(min(int(64 * a), 1 << 62), -(1 << 62)) + 1_000_000 for a in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    m = whitening.fit(d)
    assert [int(a) for a in m.sums] == s
    small = np.array(x[:1], dtype=np.int64)
    assert m.deviation(small) == [want[0]]

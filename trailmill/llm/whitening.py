"""Operator 11, whitening of embeddings by a covariance found in two passes.

The first pass gives exact integer sums and so the mean; the second sums outer products of the centred
vectors, one matrix product for each batch, and a tree of merges adds the matrices of all partitions.
The eigenvectors of the covariance come from the symmetric solver of LAPACK on the driver, which holds
``d * d`` doubles whatever the number of rows; ``d * components`` of them are broadcast for the projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import materialise

#: Entries are counted in 64ths, above a base that keeps them positive.
STEPS, BASE = 64, 1_000_000
#: Rows of a batch that are turned into one matrix.
ROWS = 4096
#: A component counts as empty if its eigenvalue is below this share of the largest, for each dimension.
EMPTY = np.finfo(float).eps


@dataclass
class Whitening:
    """What the fit gives. ``axes`` has one column for each component."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums`` exactly: long, or whole numbers of any size where that could overflow."""
        return self.n * _roomy(x, self.n) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(float)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; a component without variance gives NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (self.centred(x) @ self.axes) / np.sqrt(self.eigenvalues)
        out[:, self.eigenvalues == 0] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of the squares of ``n * x - sums``, in whole numbers of any size."""
        d = self.scaled(x)
        if d.dtype != object and (d.size == 0 or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63):
            return (d * d).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in d.tolist()]


def _roomy(x: np.ndarray, times: int) -> np.ndarray:
    """``x`` as it is if ``times`` of any entry, or as many of them added, stay within a long."""
    return x if x.size == 0 or max(-int(x.min()), int(x.max())) * times < 1 << 62 else x.astype(object)


def _usable(df: DataFrame, vector_col: str, *keep: Column) -> DataFrame:
    """``keep`` and ``_x``, the vector in whole steps (held within 2**62), of rows whose vector is whole and finite."""
    v = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    d = df.select(*keep, v.cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull() & ~F.exists("_v", bad))
    most = F.lit(1 << 62)
    steps = lambda c: F.least(F.greatest(F.floor(c * STEPS), -most), most) + F.lit(BASE).cast("long")
    return d.select(*(c for c in d.columns if c != "_v"), F.transform("_v", steps).alias("_x"))


def _matrices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[np.ndarray]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            c = b.column(at).slice(i, ROWS)
            yield c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def _summed(fit: DataFrame, partial, size: int) -> np.ndarray:
    """Sum over all partitions of what ``partial`` makes of each matrix, merged as a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _matrices(batches, 0):
            total += partial(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["_m"])

    add = lambda a, b: a + b
    return fit.select("_x").mapInArrow(run, "_m binary").rdd.treeAggregate(np.zeros(size), lambda a, r: a + np.frombuffer(bytes(r[0])), add, 2)


def fit(vectors: DataFrame, components: int = 16, vector_col: str = "embedding") -> Whitening | None:
    """Fits on each distinct vector once; None if no row has a usable one.

    Rows with a null vector, null or non-finite entries don't count, nor do vectors without entries or of
    another length than the most frequent one (ties: the longest), which can't be compared with the rest.
    The distinct vectors are written once and read by every pass; copies are merged before the shuffle, so
    a frequent vector reaches its task as one row from each part.
    """
    distinct = materialise(_usable(vectors, vector_col).filter(F.size("_x") > 0).distinct(), "whitening")
    length = distinct.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return None
    d, n = length["d"], length["n"]
    table = distinct.filter(F.size("_x") == d)
    first = table.mapInArrow(_whole_sums, "_at int, _s decimal(38,0)").groupBy("_at").agg(F.sum("_s").alias("_s"))
    sums = np.array([int(r["_s"]) for r in first.orderBy("_at").collect()], dtype=object)
    sums = sums if max(map(abs, sums)) >= 1 << 62 else sums.astype(np.int64)
    w = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    cov = _summed(table, lambda x: (c := w.centred(x)).T @ c, d * d).reshape(d, d) / n
    e, v = np.linalg.eigh((cov + cov.T) / 2)
    e, v = e[::-1], v[:, ::-1]
    trace = float(np.trace(cov))
    top = min(components, d)
    kept = np.where(e > max(e[0], 0) * d * EMPTY, e, 0.0)[:top]
    w = Whitening(n, sums, np.ascontiguousarray(v[:, :top]), kept, kept / trace if trace > 0 else np.zeros(top), 0.0)
    live = kept > 0
    if live.any():
        got = _summed(table, lambda x: (y := w.project(x)[:, live]).T @ y, int(live.sum()) ** 2).reshape(int(live.sum()), -1) / n
        w.identity_error = float(np.abs(got - np.eye(len(got))).max())
    return w


def _whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _matrices(batches, 0):
        s = _roomy(x, len(x)).sum(axis=0).astype(object)
        total = s if total is None else total + s
    if total is not None:
        wide = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), wide], names=["_at", "_s"])


def whiten(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", id_cols: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``id_cols``, ``_deviation`` (exact, a decimal of 38 digits) and ``_whitened`` (array of doubles, one
    for each component) of every usable row whose vector has the length of the fit.

    Repeated rows and null ids are kept, each with its result; an empty table stays empty. A component
    without variance has a null in ``_whitened``. Other columns are left out, so no name clashes.
    """
    d = _usable(vectors, vector_col, *(F.col(c).alias(f"_i{k}") for k, c in enumerate(id_cols)))
    types = [vectors.schema[c].dataType.simpleString() for c in id_cols]
    out = ", ".join([*(f"_i{k} {t}" for k, t in enumerate(types)), "_deviation decimal(38,0)", "_whitened array<double>"])
    if model is None:
        return d.limit(0).mapInArrow(lambda b: iter(()), out).toDF(*id_cols, "_deviation", "_whitened")
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                x = next(_matrices(iter([b]), b.num_columns - 1))
                y = m.project(x)
                flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
                offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                dev = pa.array([Decimal(v) for v in m.deviation(x)], pa.decimal128(38, 0))
                names = [*b.schema.names[:-1], "_deviation", "_whitened"]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], dev, pa.ListArray.from_arrays(offsets, flat)], names=names)

    return d.filter(F.size("_x") == len(model.sums)).mapInArrow(run, out).toDF(*id_cols, "_deviation", "_whitened")

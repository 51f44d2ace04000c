"""Sequential work on ordered groups: rows are dealt by key, sorted, and handed over group by group.

A group is a dict of numpy arrays. Only one group at a time is held beyond an Arrow batch. Use this
where a row depends on what was kept before it, which a window function can't express.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Group = dict[str, np.ndarray]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end with a group, and where their groups begin."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        first, end = ([b.column(b.schema.get_field_index(k))[i].as_py() for k in keys] for i in (0, b.num_rows - 1))
        held.append(b)
        if last is not None and first == end == last:
            continue
        last = end
        t = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(t, keys)
        cut = int(starts[-1])
        if cut:
            yield t.slice(0, cut), starts[:-1]
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _starts(t, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        with np.errstate(invalid="ignore"):
            change = v[1:] != v[:-1]
        if v.dtype.kind == "f":
            change &= ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
        new[1:] |= change
    return np.flatnonzero(new)


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def filter_groups(df: DataFrame, keys: list[str], order: list[str], keep: Callable[[Group], np.ndarray]) -> DataFrame:
    """The rows that ``keep`` marks in each group. Nulls of numbers are NaN there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, keys):
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            ends = [*starts[1:], t.num_rows]
            mask = np.concatenate([keep({c: v[s:e] for c, v in cols.items()}) for s, e in zip(starts, ends, strict=True)])
            yield from t.filter(pa.array(mask)).to_batches()

    return _dealt(df, keys, order).mapInArrow(run, df.schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Group], dict[str, list | np.ndarray]], schema: str) -> DataFrame:
    """One output table for each group: ``fn`` gives the columns of ``schema``, of any one length."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, keys):
            cols = {c: t.column(c).to_numpy() for c in t.column_names}
            outs = [fn({c: v[s:e] for c, v in cols.items()}) for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True)]
            arrays = [pa.array([x for o in outs for x in o[f.name]], f.type, from_pandas=True) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return _dealt(df, keys, order).mapInArrow(run, target)

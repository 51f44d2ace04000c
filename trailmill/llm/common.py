"""Shared pieces: text columns, size-checked broadcasts and scratch tables in the shared folder."""

from __future__ import annotations

import os
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.scratch import materialise, scratch_root

__all__ = ["materialise", "scratch_root", "ascii_lower", "broadcast_if_small", "join_counted", "without_clash", "with_own_names", "tokenizer_path", "pieces"]

#: The six bytes that count as white space: 20 and 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"

#: A side is broadcast only if its measured rows and bytes are below these.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 32 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII values take the faster built-in."""
    upper = string.ascii_uppercase
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hints a broadcast if the measured size, of all columns and array elements, is below the bounds;
    else leaves the join to a shuffle. ``df`` should be a written table: it is read once for this."""
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and b <= BROADCAST_BYTES else df


#: A key is frequent if it has one in so many of all rows: there are at most so many such keys.
FREQUENT_SHARE = 2000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join with a table of one row for each key, in which ``count`` says how many rows of ``left``
    have it. Frequent keys, at most ``FREQUENT_SHARE``, are met by a broadcast, so that no task gets all
    rows of one; the others by a shuffle. Both sides should be written tables."""
    total = right.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * FREQUENT_SHARE >= total
    hot = F.broadcast(right.filter(often).drop(count))
    rest = left.join(F.broadcast(right.filter(often).select(key)), key, "left_anti").join(right.filter(~often).drop(count), key)
    return left.join(hot, key).unionByName(rest)


def without_clash(docs: DataFrame, *outputs: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` with its columns renamed ``_c0, _c1, ..``, so that no name inside an operator clashes with
    them; their own names; and own name to new one. Columns named like an output are left out: the
    output takes their place."""
    names = [c for c in docs.columns if c not in outputs]
    new = {c: f"_c{i}" for i, c in enumerate(names)}
    return docs.select(*(docs[f"`{c}`"].alias(n) for c, n in new.items())), names, new


def with_own_names(df: DataFrame, names: list[str], new: dict[str, str], outputs: dict[str, Column]) -> DataFrame:
    """What ``without_clash`` renamed under its own names, and the outputs under theirs."""
    out = df.select(*(F.col(new[c]) for c in names), *(v.alias(f"_o{i}") for i, v in enumerate(outputs.values())))
    return out.toDF(*names, *outputs)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(batch, text_at: int, most: int = 4 << 20):
    """Slices of an Arrow batch with about ``most`` bytes of text each, at least one row."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end

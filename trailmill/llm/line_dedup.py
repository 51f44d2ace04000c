"""Operator 8, line dedup: explode normalised lines, hash, count documents per hash, drop lines
over the threshold and put the rest together by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import BLANKS, ascii_lower, materialise, with_own_names, without_clash

#: A line is frequent if one in so many counts of common lines is its own: there are at most so many.
SHARE = 2000


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two hashes that start from different seeds."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2")]


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_kept`` (its text without the dropped lines), ``_n_lines`` and ``_n_dropped``.

    A key of at least ``min_chars`` code points that is found in at least ``min_docs`` rows loses all
    its lines except in the row with the largest id. A null or empty text is one empty line and stays.
    A row is a document: repeated rows count apart, and rows that tie for the largest id all keep the
    line; a null id is smaller than any other. An empty table gives an empty table. Other columns pass,
    whatever their names; one that is named like a result is replaced.

    Lines of one document that share a key are counted once before the shuffle, so a frequent line
    costs one row per document and is summed on the map side. The second pass moves only line
    positions; texts move once, to meet the positions that they lose. The most frequent lines, at most
    ``SHARE``, are met by a broadcast: no task gets all rows of one.
    """
    docs, names, new = without_clash(docs, "_kept", "_n_lines", "_n_dropped")
    i, text = new[id_col], new[text_col]
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    d = docs.withColumn("_lines", lines).withColumn("_th", F.xxhash64(text))
    keys = d.select(i, F.explode(F.array_distinct(F.transform("_lines", line_key))).alias("_key")).filter(F.length("_key") >= min_chars)
    common = keys.select(i, *_hashes(F.col("_key"))).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.max(i).alias("_keeper")).filter(F.col("_n") >= min_docs)
    common = materialise(common, "common")
    total = common.agg(F.sum("_n")).first()[0] or 0
    frequent = F.col("_n") * SHARE >= total
    placed = d.select(i, "_th", F.size("_lines").alias("_size"), F.posexplode("_lines").alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line"))).filter(F.length("_key") >= min_chars)
    placed = placed.select(i, "_th", "_size", "_pos", *_hashes(F.col("_key")))
    hot = common.filter(frequent).select("_h1", "_h2", F.struct("_keeper").alias("_by"))
    placed = placed.join(F.broadcast(hot), ["_h1", "_h2"], "left")
    # A frequent line needs no partner: it goes to the join under a key that is its own.
    alone = F.when(F.col("_by").isNotNull(), F.xxhash64("_th", "_pos", i)).otherwise(F.col("_h1"))
    cold = common.filter(~frequent).select(F.col("_h1").alias("_j1"), F.col("_h2").alias("_j2"), F.struct("_keeper").alias("_cold"))
    placed = placed.withColumn("_k1", alone).join(cold, (F.col("_k1") == F.col("_j1")) & (F.col("_h2") == F.col("_j2")) & F.col("_by").isNull(), "left")
    by = F.coalesce("_by", "_cold")
    lost = placed.filter(by.isNotNull() & ~F.col(i).eqNullSafe(by["_keeper"]))
    stay = (
        lost.groupBy(F.col(i).alias("_id"), F.col("_th").alias("_rth"))
        .agg(F.first("_size").alias("_size"), F.collect_set("_pos").alias("_gone"))
        .select("_id", "_rth", F.size("_gone").alias("_lost"), F.array_except(F.expr("sequence(0, _size - 1)"), "_gone").alias("_stay"))
    )
    stay = stay.withColumn("_stay", F.when(F.col("_lost") > 0, F.col("_stay")))
    d = docs.withColumn("_th", F.xxhash64(text))
    joined = d.join(stay, d[i].eqNullSafe(stay["_id"]) & (d["_th"] == stay["_rth"]), "left").withColumn("_lines", lines)
    kept = F.when(F.col("_stay").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform("_stay", lambda k: F.get("_lines", k)), "\n"))
    outputs = {"_kept": kept, "_n_lines": F.size("_lines").cast("long"), "_n_dropped": F.coalesce(F.col("_lost"), F.lit(0)).cast("long")}
    return with_own_names(joined, names, new, outputs)

"""Operator 5, substring dedup by a log-structured index of window fingerprints.

A window is ``WINDOW`` words. Its fingerprint is the smallest hash of the ``GRAM``-word sequences in
it, so equal windows have equal fingerprints at the same place, and neighbouring windows mostly
share one. The index holds (fingerprint, document, place) in immutable runs, each bucketed and sorted
by the fingerprint, so that a new batch is merge-joined with them where they lie. Places whose
fingerprint was met before are verified on the words themselves; the batch stays as a run of its own,
and runs beyond a number are compacted into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.llm.common import materialise, pieces, scratch_root

WINDOW = 20
GRAM = 8
#: Odd multiplier of the polynomial hash of word sequences.
BASE = 0x9E3779B97F4A7C15
#: A fingerprint is frequent if it has ``FREQUENT`` rows at least, and one in ``SHARE`` of all, among the
#: documents of which one in ``SAMPLE`` is taken: at most ``SHARE`` are.
FREQUENT, SHARE, SAMPLE = 16, 2000, 64


def _joined(h: np.ndarray, k: int, g: np.ndarray, n: int) -> np.ndarray:
    """Hashes of k + n words from those of k words and of the n that follow."""
    size = min(len(h), len(g) - k)
    return h[: max(size, 0)] * np.uint64(pow(BASE, n, 1 << 64)) + g[k : k + max(size, 0)]


def _sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by doubling."""
    out, done, power, at = None, 0, words, 1
    while True:
        if k & at:
            out, done = (power, at) if out is None else (_joined(out, done, power, at), done + at)
        at *= 2
        if at > k:
            return out
        power = _joined(power, at // 2, power, at // 2)


class _Windows:
    """Windows of the documents of a slice: ``starts``, and the place ``at`` of their fingerprints, whose
    values are in ``mark``. Places count over the slice."""

    def __init__(self, split: list[list[bytes]]):
        self.lens = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate(([0], np.cumsum(self.lens)[:-1])) if len(split) else np.zeros(0, np.int64)
        hashed = xxhash.xxh64_intdigest
        words = np.fromiter((hashed(w) for s in split for w in s), np.uint64, int(self.lens.sum()))
        self.doc = np.repeat(np.arange(len(split)), self.lens)
        n = len(words) - WINDOW + 1
        if n <= 0:
            self.starts = self.at = np.zeros(0, np.int64)
            self.mark = np.zeros(0, np.uint64)
            return
        x = _sequence_hashes(words, GRAM)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        # The upper half decides, then the place: of equal ones the leftmost is the smallest.
        low = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
        width, reach = WINDOW - GRAM + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        self.starts = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        self.at = (low[self.starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.mark = x

    def marked(self, places: pa.Array) -> np.ndarray:
        """Which windows have their fingerprint at one of the places given for each document."""
        counts = np.diff(places.offsets.to_numpy())
        flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = flat < self.lens[doc]
        mark = np.zeros(len(self.doc) + 1, bool)
        mark[self.first[doc[inside]] + flat[inside]] = True
        return mark[self.at]


def _split(texts: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in texts.to_pylist()]  # of bytes: ASCII blanks only


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _tv, _text``: ``_tv``, from a hash of the text, tells rows apart that share an id."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_tv"), text.cast("binary").alias("_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: tuple[int, ...] = ()) -> DataFrame:
    """``_key, _id, _tv, _at, _hot``: the fingerprints of the windows of every document and their word
    positions. Rows of a ``frequent`` fingerprint are ``_hot``, and their key spreads them evenly."""
    d = _versions(docs, id_col, text_col)
    schema = d.select(F.lit(0).cast("long").alias("_key"), "_id", "_tv", F.lit(0).alias("_at"), F.lit(False).alias("_hot")).schema
    often = np.sort(np.array(frequent, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 2):
                w = _Windows(_split(p.column(2)))
                at = w.at[np.flatnonzero(np.diff(w.at, prepend=-1))]  # places never go back
                doc = pa.array(w.doc[at])
                place = (at - w.first[w.doc[at]]).astype(np.int32)
                key = w.mark[at].view(np.int64)
                hot = np.isin(key, often)
                spread = (p.column(1).take(doc).to_numpy().astype(np.int64) + place) * np.int64(0x9E3779B97F4A7C1)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(hot, spread, key)), p.column(0).take(doc), p.column(1).take(doc), pa.array(place), pa.array(hot)], names=["_key", "_id", "_tv", "_at", "_hot"])

    return d.mapInArrow(run, schema)


def frequent_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, ...]:
    """At most ``SHARE`` fingerprints that would fill one bucket. They are only dealt out otherwise: which
    ones they are changes no result."""
    some = docs.filter(F.pmod(F.xxhash64(F.lit("some"), id_col), F.lit(SAMPLE)) == 0)
    counts = materialise(fingerprints(some, id_col, text_col).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "some")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return tuple(r["_key"] for r in counts.filter(F.col("_n") >= max(FREQUENT, total / SHARE)).select("_key").collect())


class FingerprintIndex:
    """Immutable runs of fingerprints in a shared folder, each a table bucketed and sorted by the key.

    A manifest beside the runs names those that count, so that a later application opens the index with ``open`` and
    adds to it. It is replaced after each change; a run without an entry, left by a lost job, counts for nothing.
    ``close`` takes the runs out of the session's catalog and leaves the files.
    """

    MANIFEST = "fingerprints.json"

    def __init__(self, spark: SparkSession, root: str | None = None, max_runs: int = 4, buckets: int | None = None):
        self.spark, self.root, self.max_runs = spark, root or f"{scratch_root(spark)}/fingerprints-{uuid.uuid4().hex}", max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.frequent: tuple[int, ...] = ()
        self._columns = ""

    @classmethod
    def open(cls, spark: SparkSession, root: str, max_runs: int = 4) -> FingerprintIndex:
        """The index that an earlier application left in a folder; a new one where there is none."""
        index = cls(spark, root, max_runs)
        fs, path = index._file(cls.MANIFEST)
        if not fs.exists(path):
            return index
        told = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])
        index.buckets, index.runs, index.frequent, index._columns = told["buckets"], told["runs"], tuple(told["frequent"]), told["columns"]
        for name in index.runs:
            spark.sql(f"create table if not exists {name} ({index._columns}) using parquet clustered by (_key) sorted by (_key) into {index.buckets} buckets location '{index.root}/{name}'")
        return index

    def close(self) -> None:
        for name in self.runs:
            self.spark.sql(f"drop table if exists {name}")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _note(self, runs: list[str]) -> None:
        """Makes these the runs of the index: the manifest is written beside the old one, which it then replaces."""
        fs, path = self._file(self.MANIFEST)
        _, temp = self._file(f"{uuid.uuid4().hex}.tmp")
        out = fs.create(temp)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs, "frequent": self.frequent, "columns": self._columns}).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(temp, path)
        self.runs = runs

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        self._columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        dealt = rows.repartition(self.buckets, "_key")
        dealt.write.bucketBy(self.buckets, "_key").sortBy("_key").option("path", f"{self.root}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_frequent: bool = False) -> DataFrame:
        """Writes the fingerprints of new documents as a run and returns ``_id, _tv, _at``, the places in
        the run and in earlier ones whose fingerprint stands in the run and at another place (some
        of them more than once).

        Each earlier run is merge-joined with the new one bucket by bucket: nothing of them is shuffled.
        Places of frequent fingerprints are returned without such a join; with ``known_frequent`` the
        index knows them already. Where more than ``max_runs`` stand already, they are compacted first.
        """
        if len(self.runs) > self.max_runs:
            self.compact()
        known = self.frequent
        if not known_frequent:
            self.frequent = tuple({*known, *frequent_fingerprints(docs, id_col, text_col)})
        name = self._write(fingerprints(docs, id_col, text_col, self.frequent))
        place, new = ["_id", "_tv", "_at"], self.spark.table(name)
        cold = new.filter("not _hot")
        found = [new.filter("_hot"), cold.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_key"))).filter("_n > 1")]
        keys = cold.select("_key").distinct()
        for run in self.runs:
            old = self.spark.table(run)
            old_cold = old.filter("not _hot")
            found += [old.filter("_hot"), old_cold.join(keys.hint("merge"), "_key", "left_semi"), cold.join(old_cold.select("_key").distinct().hint("merge"), "_key", "left_semi")]
            if since := set(self.frequent) - set(known):
                found.append(old_cold.join(F.broadcast(self.spark.createDataFrame([(k,) for k in since], "_key long")), "_key", "left_semi"))
        met = found[0].select(*place)
        for x in found[1:]:
            met = met.unionByName(x.select(*place))
        met = materialise(met, "met")
        self._note([*self.runs, name])
        return met

    def compact(self) -> None:
        """Merges all runs into one. The old files stay until their owner removes them: a reader may hold them."""
        if len(self.runs) > 1:
            whole = self.spark.table(self.runs[0])
            for r in self.runs[1:]:
                whole = whole.unionByName(self.spark.table(r))
            one = self._write(whole)
            self.close()
            self._note([one])


def _next_to(docs: DataFrame, lists: DataFrame, how: str, *cols: str) -> DataFrame:
    """Texts next to the lists of their documents. Every join with the same ``docs`` has the same
    exchange of the texts, which Spark then runs once."""
    p = lists.withColumnsRenamed({"_id": "_pid", "_tv": "_ptv"})
    return docs.join(p.hint("merge"), docs["_id"].eqNullSafe(p["_pid"]) & (docs["_tv"] == p["_ptv"]), how).select("_id", "_tv", "_text", *cols)


def _stretches(joined: DataFrame, frequent: tuple[int, ...]) -> DataFrame:
    """``_fp, _sub, _id, _tv, _start, _words``: for each marked place the words of all windows that have
    it as fingerprint, from word ``_start`` on. Those of a frequent fingerprint come window by window,
    told apart by ``_sub``.

    Of equal stretches in a slice only the earliest goes on: the windows of the others are repeated.
    """
    schema = joined.select(F.lit(0).cast("long").alias("_fp"), F.lit(0).cast("long").alias("_sub"), "_id", "_tv", F.lit(0).alias("_start"), F.lit(b"").alias("_words")).schema
    often = frozenset(frequent)

    def rows(p: pa.RecordBatch) -> pa.RecordBatch:
        split = _split(p.column(2))
        w = _Windows(split)
        ids, tvs = p.column(0).to_pylist(), p.column(1).to_pylist()
        rank = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, tvs[i]))
        pick = np.flatnonzero(w.marked(p.column(3)))
        at, starts = w.at[pick], w.starts[pick]
        head = np.flatnonzero(np.diff(at, prepend=-1))
        tail = np.append(head[1:], len(at)) - 1
        doc = w.doc[at[head]] if len(head) else head
        fps = w.mark[at[head]].view(np.int64).tolist() if len(head) else []
        begin, end = (starts[head] - w.first[doc]).tolist(), (starts[tail] - w.first[doc] + WINDOW).tolist()
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
        seen: set[tuple[int, bytes]] = set()
        out: list[tuple[int, int, int, int, bytes]] = []
        for i in rank:
            words = split[i]
            for k in range(bounds[i], bounds[i + 1]):
                fp, s, e = fps[k], begin[k], end[k]
                for a, z in ((s, e),) if fp not in often else ((j, j + WINDOW) for j in range(s, e - WINDOW + 1)):
                    text = b" ".join(words[a:z])
                    if (fp, text) not in seen:
                        seen.add((fp, text))
                        out.append((fp, xxhash.xxh64_intdigest(text) >> 1 if fp in often else 0, i, a, text))
        fp, sub, doc, start, text = zip(*out, strict=True) if out else ((),) * 5
        doc = pa.array(doc, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(sub, pa.int64()), p.column(0).take(doc), p.column(1).take(doc), pa.array(start, pa.int32()), pa.array(text, pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 2, 8 << 20):
                yield rows(p)

    return joined.mapInArrow(run, schema)


def _firsts(stretches: DataFrame) -> DataFrame:
    """``_id, _tv, _start, _mask``: bit i is set if the window at ``_start`` + i is the first of its words.

    The rows come sorted by fingerprint, document and place. What is held are the distinct windows of
    one fingerprint, or one window if the fingerprint is frequent.
    """
    cols = ["_fp", "_sub", "_id", "_tv", "_start", "_words"]
    dealt = stretches.repartition("_fp", "_sub").sortWithinPartitions("_fp", "_sub", "_id", "_tv", "_start").select(*cols)
    schema = stretches.select("_id", "_tv", "_start", F.lit(0).alias("_mask")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, held = None, set()
        for b in batches:
            masks = []
            for fp, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                if (fp, sub) != value:
                    value, held = (fp, sub), set()
                words, mask = text.split(b" "), 0
                for i in range(len(words) - WINDOW + 1):
                    window = b" ".join(words[i : i + WINDOW])
                    if window not in held:
                        held.add(window)
                        mask |= 1 << i
                masks.append(mask)
            out = pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), pa.array(masks, pa.int32())], names=schema.names)
            yield out.filter(pa.array([m > 0 for m in masks], pa.bool_()))

    return dealt.mapInArrow(run, schema)


def _without(joined: DataFrame, id_col: str) -> DataFrame:
    """The documents without the words of their repeated windows: all that are marked but the first ones."""
    schema = joined.select(F.col("_id").alias(id_col), F.lit("").alias("_kept"), F.lit(0).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("_n_removed")).schema

    def covered(split: list[list[bytes]], places: pa.Array, firsts: pa.Array) -> list[np.ndarray]:
        w = _Windows(split)
        gone = np.zeros(len(w.doc) + 1, bool)
        gone[w.starts[w.marked(places)]] = True
        counts = np.diff(firsts.offsets.to_numpy())
        flat = firsts.flatten()
        doc = np.repeat(np.arange(len(counts)), counts)
        start, mask = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for i in range(WINDOW - GRAM + 1):
            at = start + i
            bit = (mask >> i & 1 > 0) & (at < w.lens[doc])
            gone[w.first[doc[bit]] + at[bit]] = False
        step = np.zeros(len(w.doc) + WINDOW + 1, np.int32)
        at = np.flatnonzero(gone)
        step[at] += 1
        step[at + WINDOW] -= 1
        cover = np.cumsum(step)[: len(w.doc)] > 0
        return np.split(cover, w.first[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 2):
                split = _split(p.column(2))
                some = np.flatnonzero(p.column(3).is_valid().to_numpy(zero_copy_only=False))
                at = pa.array(some)
                empty = pa.array([[]] * len(some), p.column(4).type)
                firsts = p.column(4).take(at)
                firsts = pa.array([x or [] for x in firsts.to_pylist()], firsts.type) if firsts.null_count else firsts
                cover = dict(zip(some.tolist(), covered([split[i] for i in some], p.column(3).take(at), firsts if len(some) else empty), strict=True)) if len(some) else {}
                lost = [int(cover[i].sum()) if i in cover else 0 for i in range(len(split))]
                kept = [b" ".join([x for x, c in zip(words, cover[i].tolist(), strict=True) if not c] if lost[i] else words).decode() for i, words in enumerate(split)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(kept, pa.string()), pa.array(map(len, split), pa.int64()), pa.array(lost, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def _verified(docs: DataFrame, met: DataFrame, wanted: DataFrame, frequent: tuple[int, ...], id_col: str) -> DataFrame:
    places = materialise(met.groupBy("_id", "_tv").agg(F.collect_set("_at").alias("_places")), "places")
    firsts = _firsts(_stretches(_next_to(docs, places, "inner", "_places"), frequent))
    firsts = firsts.groupBy("_id", "_tv").agg(F.collect_list(F.struct("_start", "_mask")).alias("_firsts"))
    lists = places.withColumnsRenamed({"_id": "_lid", "_tv": "_ltv"})
    both = lists.join(firsts, lists["_lid"].eqNullSafe(firsts["_id"]) & (lists["_ltv"] == firsts["_tv"]), "left").select(F.col("_lid").alias("_id"), F.col("_ltv").alias("_tv"), "_places", "_firsts")
    return _without(_next_to(wanted, both, "left", "_places", "_firsts"), id_col)


def dedup_batch(docs: DataFrame, index: FingerprintIndex, after=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, _kept, _n_words, _n_removed`` for the rows of ``docs`` with ids above ``after`` (all if
    None), which become a run of ``index``.

    ``docs`` holds the new documents and those of the index, which have ids up to ``after``. Every word
    is removed that a window covers whose words also start earlier: in a document of smaller id, or
    before in the same one. Windows are judged on the input, by their words. Kept words are joined by
    one space.

    Null, empty and blank texts have no words; texts shorter than a window stay whole. Rows that share
    an id but not a text come one after another in an order by a hash of the text; rows equal in
    both are one document and get equal results. Ids are of any type that sorts; a null id is the
    smallest. An empty table gives an empty table; other columns are left out, whatever their names.

    The texts are shuffled once, fingerprints (about one for seven words) once and words around those
    met again a second time.
    """
    new = docs if after is None else docs.filter(F.col(id_col) > F.lit(after))
    met = index.add(new, id_col, text_col)
    d = _versions(docs, id_col, text_col)
    return _verified(d, met, d if after is None else _versions(new, id_col, text_col), index.frequent, id_col)


def dedup_substrings(docs: DataFrame, batches: int = 3, max_runs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_batch`` of a whole table in ``batches`` by ranges of ids, one after another through one
    index, which is compacted on the way. What they met is verified in one pass over the texts. The
    result depends on neither number. The range borders come from 1000 ids."""
    ids = docs.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col)).limit(1000)
    some = sorted(r[0] for r in ids.collect())
    borders = sorted({some[len(some) * k // batches] for k in range(1, batches)}) if some else []
    index = FingerprintIndex(docs.sparkSession, max_runs=max_runs)
    index.frequent = frequent_fingerprints(docs, id_col, text_col)
    i, met = F.col(id_col), None
    for lo, hi in zip([None, *borders], [*borders, None], strict=True):
        inside = F.lit(True) if hi is None else (i < F.lit(hi)) | i.isNull() if lo is None else i < F.lit(hi)
        part = docs.filter(inside if lo is None else inside & (i >= F.lit(lo)))
        found = index.add(part, id_col, text_col, known_frequent=True)
        met = found if met is None else met.unionByName(found)
    index.close()  # what was met is written; the runs stay as files
    d = _versions(docs, id_col, text_col)
    return _verified(d, met, d, index.frequent, id_col)

"""Operator 12, byte-level BPE by the ranks of a vocabulary file, over overlapping chunks of long texts.

Where a text is cut into chunks, each chunk is split into pre-tokens from its own start, and these are encoded, in parallel. A
pre-token depends only on what follows its start, so once two scans have one boundary in common they
agree from there on. Each chunk reaches some way into the next one; the first boundary that both
scans have there is the seam. Of every chunk the ids from its seam to that of the next are taken, and
put together in order. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import materialise, pieces, tokenizer_path

#: Code points of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 256
#: A boundary so near the end of a cut text may be due to the cut: no pre-token is decided by more than
#: three code points after its start or one after its end.
MARGIN = 3
#: How many pre-tokens a worker remembers beyond a batch, and the longest that it remembers.
MEMORY, LONG = 400_000, 64
#: No rank, and the bits of a token's number in a pair.
NONE, SHIFT = 1 << 60, 24


def pre_token_pattern(pattern: str | None = None) -> regex.Pattern:
    """The pattern of the vocabulary. White space is the Unicode property in this module as in the vocabulary's own."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern)


class Ranks:
    """A vocabulary of byte strings by rank, and what a worker remembers of pre-tokens and their packed ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)])
        joined = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    joined[a << SHIFT | b] = r
        self.pairs = np.array(sorted(joined), np.int64)
        self.made = np.array([joined[k] for k in self.pairs.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def table(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Packed ids (little-endian 32-bit) of all pre-tokens of a batch of texts."""
        words = set().union(*texts)
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > MEMORY:  # the memory starts anew, with what this batch needs of it
            self.known = {w: self.known[w] for w in words & self.known.keys()}
        raw = [w.encode() for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        self.known.update(zip([new[i] for i in short], self.merge_all([raw[i] for i in short]), strict=True))
        if len(short) == len(new):
            return self.known
        long = {new[i]: _packed(self.merge(w)) for i, w in enumerate(raw) if len(w) > LONG}
        return self.known | long

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or ``NONE``."""
        key = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NONE)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of all words, none of them empty. In each word the adjacent pair of lowest rank, of equal ones the
        leftmost, is joined until none has a rank; a round does so once in every word that still has one."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        which = np.arange(len(words))
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.append(self.joined(token[:-1], token[1:]), NONE)[: len(token)]
        rank[np.cumsum(size) - 1] = NONE
        while len(which):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            done = least == NONE
            if done.any():
                packed = token[np.repeat(done, size)].astype("<u4").tobytes()
                at = 0
                for i, n in zip(which[done].tolist(), (4 * size[done]).tolist(), strict=True):
                    out[i] = packed[at : at + n]
                    at += n
                live = np.repeat(~done, size)
                token, rank, which, size, least = token[live], rank[live], which[~done], size[~done], least[~done]
                if not len(which):
                    break
                start = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(least, size))
            of = np.searchsorted(start, hit, side="right")
            at = hit[np.concatenate(([True], of[1:] != of[:-1]))]
            token[at] = least
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, rank = token[keep], rank[keep]
            size = size - 1
            at = at - np.arange(len(at))  # where the new tokens are now
            start = np.cumsum(size) - size
            end = start + size - 1
            rank[at] = NONE
            i = at[at < end]
            rank[i] = self.joined(token[i], token[i + 1])
            i = at[at > start] - 1
            rank[i] = self.joined(token[i], token[i + 1])
        return out

    def merge(self, w: bytes) -> list[int]:
        """The ids of one word; parts are a linked list over their first bytes and the pairs wait in a heap, so that a
        long word costs its length times the logarithm of it."""
        n, rank = len(w), self.rank.get
        if w in self.rank:
            return [self.rank[w]]
        end = list(range(1, n + 1))  # of the part that starts here
        left = list(range(-1, n - 1))  # start of the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(w[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two has been joined to something else
            end[i], end[mid] = stop, 0
            if stop < n:
                left[stop] = i
                if (r := rank(w[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := rank(w[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank[w[i : end[i]]])
            i = end[i]
        return out


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def decode(v: Ranks, packed: bytes) -> bytes:
    """The bytes of the ids, one after another."""
    return b"".join(map(v.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def cut(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of ``size`` code points, each with up to ``overlap`` of what follows; a text of ``size`` or fewer is one chunk."""
    return [text[i : i + size + overlap] for i in range(0, max(len(text), 1), size)]


def boundaries(words: regex.Pattern, chunk: str) -> list[int]:
    """Ends of the pre-tokens of a chunk, after its start."""
    return [0, *(m.end() for m in words.finditer(chunk))]


def encode(
    docs: DataFrame,
    path: str | None = None,
    text_col: str = "text",
    id_cols: tuple[str, ...] = ("doc_id",),
    with_ids: bool = True,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    pattern: str | None = None,
) -> DataFrame:
    """``id_cols``, ``_n_tokens``, ``_ids`` (little-endian 32-bit, left out unless ``with_ids``),
    ``_ids_sha256`` and ``_decoded_sha256`` of every row.

    A null text is empty and has no tokens; no special tokens are known. Repeated rows get equal results,
    null ids are kept, an empty table stays empty; other columns are left out, so no name clashes. A text of
    one chunk is encoded where it is read. The chunks of longer ones are dealt to all tasks; only their ids
    meet again. Where two chunks have no common boundary in the overlap, since one pre-token is longer than
    that, the chunks are put together and the whole text is scanned as one. A text is one value, so one task holds it.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be at least one code point and at most a chunk")
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    own = [f"_i{k}" for k in range(len(id_cols))]
    d = docs.select(*(F.col(c).alias(o) for c, o in zip(id_cols, own, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    short = F.length("_text") <= chunk
    whole = _digests(d.filter(short), own, _encode_whole, path, pattern, with_ids)
    chunks = _chunks(d.filter(~short), own, chunk, overlap)
    sewn = _sewn(chunks, own, path, pattern, chunk, overlap)
    joined = _digests(sewn.filter("not _torn").select(*own, "_ids"), own, _joined, path, pattern, with_ids)
    part = F.struct("_k", F.when(F.col("_k") < F.col("_last"), F.substring("_text", 1, chunk)).otherwise(F.col("_text")).alias("t"))
    texts = chunks.join(sewn.filter("_torn").select("_row"), "_row", "left_semi").groupBy("_row").agg(*(F.max(o).alias(o) for o in own), F.array_sort(F.collect_list(part)).alias("_p"))
    again = _digests(texts.select(*own, F.array_join("_p.t", "").alias("_text")), own, _encode_whole, path, pattern, with_ids)
    return whole.unionByName(joined).unionByName(again).toDF(*id_cols, *(c for c in whole.columns if c not in own))


def _encode_whole(v: Ranks, words: regex.Pattern, texts: list[str]) -> list[bytes]:
    split = [words.findall(t) for t in texts]
    table = v.table(split)
    return [b"".join(map(table.__getitem__, x)) for x in split]


def _joined(v: Ranks, words: regex.Pattern, parts: list[list[bytes]]) -> list[bytes]:
    return [b"".join(p) for p in parts]


def _digests(d: DataFrame, own: list[str], to_ids, path: str, pattern: str | None, with_ids: bool) -> DataFrame:
    """Counts and hashes of the ids that ``to_ids`` makes of the last column, texts or lists of packed ids."""
    out = [("_n_tokens", "long", pa.int64()), *([("_ids", "binary", pa.binary())] if with_ids else []), ("_ids_sha256", "string", pa.string()), ("_decoded_sha256", "string", pa.string())]
    d = d.select(*own, d.columns[-1])
    schema = d.select(*own).selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t, _ in out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words = ranks(path), pre_token_pattern(pattern)
        for b in (p for whole in batches for p in _parts(whole)):
            packed = to_ids(v, words, b.column(b.num_columns - 1).to_pylist())
            cols = [[len(p) // 4 for p in packed], *([packed] if with_ids else [])]
            cols += [[hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(decode(v, p)).hexdigest() for p in packed]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, (_, _, t) in zip(cols, out, strict=True))], names=[*own, *(n for n, _, _ in out)])

    return d.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded size of texts; lists of ids are of long texts, so each is a part."""
    if pa.types.is_list(batch.column(batch.num_columns - 1).type):
        return (batch.slice(i, 1) for i in range(batch.num_rows))
    return pieces(batch, batch.num_columns - 1)


def _chunks(long: DataFrame, own: list[str], size: int, overlap: int) -> DataFrame:
    """``own, _row, _k, _last, _text``: the chunks of texts, written once and dealt to files by row and number.
    Only the first chunk of a row has the columns ``own``. ``_row`` holds for this table alone."""
    d = long.withColumn("_row", F.monotonically_increasing_id()).select(*own, "_row", "_text")
    schema = d.drop("_text").selectExpr("*", "0 as _k", "0 as _last", "'' as _text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):
                parts = cut(b.column("_text")[0].as_py(), size, overlap)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    ids = [pa.concat_arrays([b.column(o) if i == 0 else pa.nulls(1, b.column(o).type), pa.nulls(len(some) - 1, b.column(o).type)]) for o in own]
                    row = pa.array([b.column("_row")[0].as_py()] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([*ids, row, pa.array(range(i, i + len(some)), pa.int32()), pa.array([len(parts) - 1] * len(some), pa.int32()), pa.array(some, pa.string())], names=[*own, "_row", "_k", "_last", "_text"])

    return materialise(d.mapInArrow(run, schema).repartition("_row", "_k"), "chunks")


def _sewn(chunks: DataFrame, own: list[str], path: str, pattern: str | None, size: int, overlap: int) -> DataFrame:
    """``own, _row, _ids, _torn``: the packed ids of the chunks of each text, cut at the seams, in order; no ids but
    ``_torn`` where a seam is missing. Each chunk sends its ids, and where in them the boundaries of the two overlaps are."""
    ints = pa.list_(pa.int32())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words = ranks(path), pre_token_pattern(pattern)
        for b in (p for whole in batches for p in pieces(whole, whole.num_columns - 1)):
            cols: list[list] = [[], [], [], [], []]
            texts = b.column("_text").to_pylist()
            bounds = [boundaries(words, t) for t in texts]
            split = [[t[i:j] for i, j in zip(e, e[1:], strict=False)] for t, e in zip(texts, bounds, strict=True)]
            table = v.table(split)
            for text, ends, parts in zip(texts, bounds, split, strict=True):
                packed = [table[x] for x in parts]
                at = np.cumsum([0, *map(len, packed)])
                e = np.array(ends)
                head = e < overlap
                tail = (e >= size) & (e <= len(text) - (MARGIN if len(text) == size + overlap else 0))
                for c, x in zip(cols, (e[head], at[head], e[tail] - size, at[tail], b"".join(packed)), strict=True):
                    c.append(x)
            out = [pa.array(c, t) for c, t in zip(cols, (ints, ints, ints, ints, pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], *names])

    names = ("_head", "_head_at", "_tail", "_tail_at", "_ids")
    more = [f"cast(null as {'binary' if n == '_ids' else 'array<int>'}) as {n}" for n in names]
    scanned = chunks.mapInArrow(scan, chunks.drop("_text").selectExpr("*", *more).schema)
    g = scanned.groupBy("_row").agg(*(F.max(o).alias(o) for o in own), F.array_sort(F.collect_list(F.struct("_k", *names))).alias("_p"))

    def sew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, torn = [], []
            for parts in (p.as_py() for p in b.column("_p")):
                cuts = _cuts(parts)
                torn.append(cuts is None)
                out.append([p["_ids"][i:j] for p, (i, j) in zip(parts, cuts, strict=True)] if cuts else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.binary())), pa.array(torn)], names=[*b.schema.names[:-1], "_ids", "_torn"])

    d = g.select("_row", *own, "_p")
    return materialise(d.mapInArrow(sew, d.drop("_p").selectExpr("*", "cast(null as array<binary>) as _ids", "false as _torn").schema), "sewn")


def _cuts(parts: list[dict]) -> list[tuple[int, int | None]] | None:
    """Where in the ids of each chunk those between its seams begin and end; None where a seam is missing."""
    starts, ends = [0], []
    for a, b in zip(parts, parts[1:], strict=False):
        tail = dict(zip(a["_tail"], a["_tail_at"], strict=True))
        seam = next(((tail[e], at) for e, at in zip(b["_head"], b["_head_at"], strict=True) if e in tail), None)
        if seam is None:
            return None
        ends.append(seam[0])
        starts.append(seam[1])
    return list(zip(starts, [*ends, None], strict=True))

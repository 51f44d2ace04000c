"""Operator 4, byte-level BPE encoding and decoding by a traversal of a prefix-sharing trie.

The encoding of a prefix is known from its last token alone: the rest of it is the encoding of what
stands before that token. So every trie node has one state, the last token of its prefix, found from
the states above it; words that share a prefix share the states. The trie is walked depth first, in
the order of the sorted words, and only the states of the current path are held.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import tokenizer_path

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a worker remembers of words and of token pairs; beyond it the memory starts anew.
WORD_MEMORY = 400_000
PAIR_MEMORY = 1_000_000
#: Longer words are encoded and forgotten.
LONG_WORD = 64


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, with the pieces that each token was merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self._whole: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank[pair] = r
            self.parts.setdefault(made, (*pair, r))
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def stands(self, left: int, right: int, until: int = 1 << 60) -> bool:
        """Whether the two tokens stay as they are when their texts are encoded as one, as far as the
        merges before rank ``until`` go.

        Merges are undone from the last to the first on both sides of the border; the pair is lost if
        a merge across the border comes before those. A tie goes to the left, which is merged first.
        """
        end_left = end_right = until  # when the pieces at the border are merged away
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < end_left and r <= end_right:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            made_left, made_right = a[2] if a else -1, b[2] if b else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left >= made_right:
                left, end_left = a[1], made_left
            else:
                right, end_right = b[0], made_right

    def whole(self, token: int) -> bool:
        """Whether the text of the token is encoded as the token."""
        if token not in self._whole:
            p = self.parts.get(token)
            self._whole[token] = len(self.bytes_of[token]) == 1 or p is not None and self.whole(p[0]) and self.whole(p[1]) and self.stands(*p)
        return self._whole[token]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class TrieEncoder:
    """Encodes batches of words; remembers words and which token pairs stand."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.pairs = v, {}, {}

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of every word."""
        if len(self.known) + len(words) > WORD_MEMORY:
            self.known = {}
        if len(self.pairs) > PAIR_MEMORY:
            self.pairs = {}
        new = sorted((w.encode(), w) for w in words if w not in self.known)
        here: dict[str, bytes] = {}
        ids, stands, whole, pairs, longest = self.v.ids.get, self.v.stands, self.v.whole, self.pairs, self.v.longest
        w = before = b""
        # path[i]: (token, its length), the last of the encoding of the prefix of i bytes, once it was asked for
        path: list[tuple[int, int] | None] = [None]

        def state(end: int) -> tuple[int, int]:
            for n in range(min(end, longest), 0, -1):
                t = ids(w[end - n : end])
                if t is None:
                    continue
                if n == end:
                    if not whole(t):
                        continue
                else:
                    last = (path[end - n] or state(end - n))[0]
                    ok = pairs.get((last, t))
                    if ok is None:
                        ok = pairs[last, t] = stands(last, t)
                    if not ok:
                        continue
                path[end] = found = (t, n)
                return found
            raise ValueError("the vocabulary lacks a byte")

        for w, text in new:
            depth = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                depth += 1
            path[depth + 1 :] = [None] * (len(w) - depth)
            for end in range(LONG_WORD, len(w), LONG_WORD):  # so that no search goes deep
                path[end] = path[end] or state(end)
            at, out = len(w), []
            while at:
                t, n = path[at] or state(at)
                out.append(t)
                at -= n
            packed = pack(f"<{len(out)}I", *out[::-1])
            if len(w) <= LONG_WORD:
                self.known[text] = packed
            else:
                here[text] = packed
            before = w
        return {w: here[w] if w in here else self.known[w] for w in words} if here else self.known


def split_text(v: Vocabulary, text: str) -> list[str | int]:
    """Words of the text in order, and the ids of special tokens written in it."""
    if not v.split_special or not any(s in text for s in v.special):
        return _WORDS.findall(text)
    out: list[str | int] = []
    at = 0
    for m in v.split_special.finditer(text):
        out += _WORDS.findall(text[at : m.start()])
        out.append(v.special[m[0]])
        at = m.end()
    return out + _WORDS.findall(text[at:])


_WORDS = regex.compile(PATTERN)


def decode(v: Vocabulary, ids: list[int]) -> str:
    """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``id_cols``, ``_n_tokens``, ``_ids`` (little-endian 32-bit, left out unless ``with_ids``),
    ``_ids_sha256`` and ``_decoded_sha256`` of every row.

    No special tokens are added; those written in a text are found in it. A null text is empty and has
    no tokens. Repeated rows get equal results, an empty table stays empty; other columns are left out.
    Rows are encoded where they are read, batch by batch: there is no shuffle, and a task holds one
    batch, its distinct words and a bounded memory of earlier ones.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    d = docs.select(*id_cols, F.col(text_col).alias("_text"))
    more = [("_n_tokens", "long", pa.int64()), *([("_ids", "binary", pa.binary())] if with_ids else []), ("_ids_sha256", "string", pa.string()), ("_decoded_sha256", "string", pa.string())]
    schema = d.drop("_text").selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t, _ in more)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        encoder = TrieEncoder(v)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                split = [split_text(v, t.as_py() or "") for t in b.column(b.num_columns - 1)]
                table = encoder.encode_words({w for s in split for w in s if w.__class__ is str})
                cols: list[list] = [[], [], [], []]
                for s in split:
                    try:
                        packed = b"".join(map(table.__getitem__, s))
                    except KeyError:
                        packed = b"".join(table[w] if w.__class__ is str else w.to_bytes(4, "little") for w in s)
                    ids = np.frombuffer(packed, "<u4").tolist()
                    cols[0].append(len(ids))
                    cols[1].append(packed)
                    cols[2].append(hashlib.sha256(packed).hexdigest())
                    cols[3].append(hashlib.sha256(decode(v, ids).encode()).hexdigest())
                out = [pa.array(c, t) for c, t in zip([cols[0], *([cols[1]] if with_ids else []), *cols[2:]], [t for _, _, t in more], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*id_cols, *(n for n, _, _ in more)])

    return d.mapInArrow(run, schema)

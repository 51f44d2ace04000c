"""Operator 12 against the tiktoken library, with chunks of many sizes."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmill.llm import byte_bpe, queries
from trailmill.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank, special_tokens={})


def texts(n=200, seed=4):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'l", "9", "é", " ", "\x1c", "!", "--", "　", "日本", "😀", "x" * 50, "=" * 20]
    return [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 400)))) for i in range(n)] + [(900, None), (901, ""), (None, "abc " * 300), (1, "abc")]


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 16), (7, 3), (40, 30), (5, 5), (16_384, 256)])
def test_chunks_change_nothing(spark, library, chunk, overlap):
    docs = texts()
    d = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], "doc_id long, text string, _text string, _row string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    out = byte_bpe.encode(d, chunk=chunk, overlap=overlap).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["_ids"], "<u4").tolist()) for r in out), key=key) == sorted(((i, library.encode_ordinary(t or "")) for i, t in docs), key=key)
    assert {(r["_n_tokens"], r["_ids_sha256"]) for r in out} == {(len(r["_ids"]) // 4, hashlib.sha256(r["_ids"]).hexdigest()) for r in out}
    assert sorted(r["_decoded_sha256"] for r in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in docs)


def test_long_pre_tokens_and_very_long_texts(spark, library):
    docs = [(1, "=" * 5000), (2, " " * 3000 + "x"), (3, "word " * 30_000), (4, "ab'" * 9000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk, overlap in ((1024, 64), (16_384, 256)):
        got = {r["doc_id"]: np.frombuffer(r["_ids"], "<u4").tolist() for r in byte_bpe.encode(d, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: library.encode_ordinary(t) for i, t in docs}


def test_query(spark, library, tmp_path):
    docs = texts(50)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_byte_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(i, (ids := library.encode_ordinary(t or "")) and len(ids) or 0, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, t in docs]
    assert sorted((r[0] or -1, r[1], r[2]) for r in got.collect()) == sorted((i or -1, n, h) for i, n, h in want)


def test_empty_table(spark):
    out = byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "_n_tokens", "_ids", "_ids_sha256", "_decoded_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(2, 30), st.integers(1, 30))
def test_seams_by_hand(text, size, overlap):
    """Boundaries that two neighbouring chunks share are boundaries of the whole text from there on."""
    overlap = min(size, overlap)
    words = byte_bpe.pre_token_pattern()
    whole = set(byte_bpe.boundaries(words, text))
    parts = byte_bpe.cut(text, size, overlap)
    true = True  # whether the scan of the chunk before is known to be right at its end
    for k in range(1, len(parts)):
        before, here = parts[k - 1], parts[k]
        limit = len(before) - (byte_bpe.MARGIN if len(before) == size + overlap else 0)
        tail = {e - size for e in byte_bpe.boundaries(words, before) if size <= e <= limit}
        common = tail & {e for e in byte_bpe.boundaries(words, here) if e < overlap}
        true = true and bool(common)
        if true:
            assert min(common) + k * size in whole


def test_merges_against_the_library(library, monkeypatch):
    """Word by word and all at once, and with a memory that is always full."""
    r = random.Random(9)
    v = byte_bpe.ranks(PATH)
    words = sorted({bytes(r.choice(b"theand \xc3\xa9s") for _ in range(r.randint(1, 60))) for _ in range(2000)})
    want = [library._encode_single_piece(w) for w in words]
    assert [v.merge(w) for w in words] == want
    assert [np.frombuffer(p, "<u4").tolist() for p in v.merge_all(words)] == want
    assert v.merge_all([]) == []
    monkeypatch.setattr(byte_bpe, "MEMORY", 3)
    texts = [[f"w{k}", "the", "x" * 100 + str(k)] for k in range(20)]
    for t in texts:
        table = v.table([t])
        assert [np.frombuffer(table[w], "<u4").tolist() for w in t] == [library.encode_ordinary(w) for w in t]

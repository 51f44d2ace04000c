"""The pipeline on a small table against plain versions of its stages."""

from __future__ import annotations

import json
import random

import corpus_pipeline
import numpy as np
import pytest
from tests.llm import brute

import __spark_entry__ as entry
from trailmill.llm import queries, sql
from trailmill.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    folder = str(tmp_path_factory.mktemp("sf"))
    syllables = {"en": ["th", "er", "on", "ing", "at"], "fr": ["eau", "oi", "éx", "qu", "ent"]}
    word = lambda x: "".join(r.choice(syllables[x]) for _ in range(r.randint(1, 6)))
    text = lambda x, n: " ".join(word(x) for _ in range(n))
    shared = "This line stands in many documents, word for word."
    items = [(k, text("en", 30)) for k in range(5)]
    docs = []
    for i in range(60):
        x = "fr" if i % 3 == 0 else "en"
        t = text(x, 150)
        if i % 4 == 0:
            t = f"{shared}\n{t}"
        if i in (7, 8):
            t += " " + items[0][1]
        docs.append((i, t, x, "s", len(t)))
    docs += [(60, docs[20][1], "en", "s", 0), (61, docs[22][1].replace(docs[22][1].split()[50], "other", 1), "en", "s", 0), (62, "12 34", "en", "s", 5), (63, None, None, "s", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {i: t for i, t in docs.items() if i not in (62, 63)}  # no letters
    kept = {i: v[2] for i, v in brute.line_dedup(sorted(kept.items())).items()}
    kept = {i: t for i, t in kept.items() if i not in (60, 61)}  # copies
    hits = brute.decontaminate(sorted(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not hits[i][1]}
    assert not {7, 8} & set(kept)
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in kept.items()}


def test_stages_keep_columns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns, name
        empty = stage(spark, d.limit(0), sf_dir)
        assert empty.count() == 0 and empty.columns == d.columns


def test_stages_with_repeated_rows_clashing_columns_and_a_very_long_text(spark, sf_dir):
    """Each stage on rows that come twice, null ids, further columns named like those inside the operators, and a long text."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 30")
    some = " ".join(r["text"] for r in d.filter("doc_id = 11").collect())
    long = " ".join(f"{w}{k}" for k in range(300) for w in some.split())
    more = spark.createDataFrame([(500, long, "en", "s", len(long)), (None, some[:300] + " more words", "en", "s", 1), (None, some[:300] + " more words", "en", "s", 1)], d.schema)
    clash = d.unionByName(d.filter("doc_id = 3")).unionByName(more).withColumns({c: F.lit("own") for c in ("_id", "_text", "_fp", "_lang_pred", "_kept", "_hits", "_row", "_n_tokens")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf_dir)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert {r["_id"] + r["_row"] for r in rows} == {"ownown"} and any(r["doc_id"] == 500 for r in rows), name
        assert sum(r["doc_id"] == 3 for r in rows) == 2, name  # rows equal in id and text are one document
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    name, encoding = corpus_pipeline.STAGES[-1]
    got = sorted((r["doc_id"] or -1, r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encoding(spark, clash, sf_dir).collect())
    want = sorted((r["doc_id"] or -1, len(ids := t.encode(r["text"], add_special_tokens=False).ids), ids) for r in clash.collect())
    assert name == "encoding" and got == want
    empty = encoding(spark, clash.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_registered():
    q = entry.queries()
    assert {n for n in q if n.startswith("op")} == set(queries.queries()) and "pipeline" in q
    assert set(sql.oracle_sql()) <= set(q)
    assert json.dumps(sorted(q))

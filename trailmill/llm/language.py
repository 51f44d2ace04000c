"""Operator 7, language identification: word first, then shorter and shorter character n-grams.

A known word is scored by its log frequency in each language. An unseen word falls back to its
longest n-grams that are known, from ``MAX_GRAM`` characters down to one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import broadcast_if_small, materialise, pieces

MAX_GRAM = 5
#: What a worker remembers of words; beyond it the memory starts anew.
WORD_MEMORY = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Overlapping n-grams of the word between marks of its ends."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def training_rows(docs: DataFrame, keep: Column, docs_per_lang: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A sample of the labelled rows: all of a language, or about ``docs_per_lang`` chosen by a hash of the id."""
    labelled = docs.filter(keep & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = labelled.groupBy(F.col(lang_col).alias("_lang")).agg((F.lit(float(docs_per_lang)) / F.count(F.lit(1))).alias("_share"))
    share = broadcast_if_small(materialise(share, "shares"))
    chosen = F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1 << 30)) < F.col("_share") * (1 << 30)
    return labelled.join(share, labelled[lang_col] == share["_lang"]).filter(chosen).select("_lang", F.col(text_col).alias("_text"))


def count_features(rows: DataFrame) -> DataFrame:
    """``_lang, _n, _f, _count``: words (``_n`` 0) and n-grams with their counts in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, 1):
                words: dict[str, Counter] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(words_of(text))
                for lang, counts in words.items():
                    for n in range(MAX_GRAM + 1):
                        seen = counts
                        if n:  # each distinct word is cut once
                            seen = Counter()
                            for w, c in counts.items():
                                for g in grams_of(w, n):
                                    seen[g] += c
                        k = len(seen)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([n] * k, pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["_lang", "_n", "_f", "_count"])

    return rows.mapInArrow(run, "_lang string, _n int, _f string, _count long").groupBy("_lang", "_n", "_f").agg(F.sum("_count").alias("_count"))


class Model:
    """Log frequencies of words and n-grams: ``features[n][text]`` is a row of ``logs``."""

    def __init__(self, langs: list[str], counts: list[tuple[str, int, str, int]]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        self.features: list[dict[str, int]] = [{} for _ in range(MAX_GRAM + 1)]
        rows: list[int] = []
        for lang, n, f, _ in counts:
            if lang in at and f not in self.features[n]:
                self.features[n][f] = len(rows)
                rows.append(n)
        table = np.full((len(rows), len(langs)), 0.5)
        for lang, n, f, c in counts:
            if lang in at:
                table[self.features[n][f], at[lang]] += c
        kind = np.array(rows, dtype=np.int64)
        for n in range(MAX_GRAM + 1):
            of = kind == n
            if of.any():
                table[of] /= table[of].sum(axis=0)
        self.logs = np.log(table)

    def words(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words with a row each of log frequencies by language; left out are those of which neither
        the word nor any n-gram is known, and those without a letter."""
        known = self.features[0]
        whole = [w for w in words if w in known]
        yield whole, self.logs[[known[w] for w in whole]]
        rest = [w for w in words if w not in known and any(map(str.isalpha, w))]
        for n in range(MAX_GRAM, 0, -1):
            known, found, flat, starts, unseen = self.features[n], [], [], [], []
            for w in rest:
                if got := [known[g] for g in grams_of(w, n) if g in known]:
                    found.append(w)
                    starts.append(len(flat))
                    flat += got
                else:
                    unseen.append(w)
            if found:
                sizes = np.diff(starts, append=len(flat))
                yield found, np.add.reduceat(self.logs[flat], starts, axis=0) / sizes[:, None]
            rest = unseen


def train(docs: DataFrame, keep: Column | None = None, docs_per_lang: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all words and n-grams of about ``docs_per_lang`` labelled rows of each language (where
    ``keep`` holds), or of all its rows if it has fewer. That bound on rows is what makes the model
    small enough for the driver and for a broadcast; of the rows nothing is left out.
    """
    rows = training_rows(docs, F.lit(True) if keep is None else keep, docs_per_lang, id_col, text_col, lang_col)
    counts = sorted((r["_lang"], r["_n"], r["_f"], r["_count"]) for r in count_features(rows).collect())
    return Model(sorted({x[0] for x in counts}), counts)


class _Words(dict):
    """Word to a row of log frequencies and of shares by language; row 0 is for words that tell nothing."""

    def __init__(self, model: Model):
        self.model, self.n = model, 1
        self.logs = np.zeros((1024, len(model.langs)))
        self.shares = np.zeros_like(self.logs)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        self.update(dict.fromkeys(new, 0))
        for found, logs in self.model.words(new):
            while self.n + len(found) > len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
                self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
            e = np.exp(logs - logs.max(axis=1, keepdims=True))
            rows = slice(self.n, self.n + len(found))
            self.logs[rows], self.shares[rows] = logs, e / e.sum(axis=1, keepdims=True)
            self.update(zip(found, range(rows.start, rows.stop), strict=True))
            self.n = rows.stop


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_lang_pred`` and ``_score``.

    The prediction is the language with the largest sum of log frequencies over the words, the first
    by name if several tie; the score is its mean share over the words that tell anything. A text that
    is null or has no letter is ``und`` with score 0; so is every text if no language was learned.
    Letters without any known n-gram give the first language with score 0. Equal texts get equal
    results; other columns pass, one that is named like a result is replaced; an empty table stays empty.
    """
    docs = docs.drop("_lang_pred", "_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    at = docs.columns.index(text_col)
    schema = d.withColumn("_lang_pred", F.lit("")).withColumn("_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words = _Words(m)
        for b in (p for whole in batches for p in pieces(whole, at)):
            if len(words) > WORD_MEMORY:
                words = _Words(m)
            split = [words_of(t) if t else [] for t in b.column(at).to_pylist()]
            if m.langs:
                words.learn(set().union(*split))
            preds, scores = [], []
            for found in split:
                pred, score = "und", 0.0
                if found and m.langs:
                    ids = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                    told = ids[ids > 0]
                    if len(told):
                        best = int(words.logs[told].sum(axis=0).argmax())
                        pred, score = m.langs[best], float(words.shares[told, best].mean())
                    elif any(c.isalpha() for w in found for c in w):
                        pred = m.langs[0]
                preds.append(pred)
                scores.append(min(1.0, score))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*names, "_lang_pred", "_score"])

    return d.mapInArrow(run, schema).toDF(*docs.columns, "_lang_pred", "_score")

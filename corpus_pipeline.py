"""Corpus pipeline: five stages over ``documents``, each written and read again by its runner.

Every stage but the last returns the columns of ``documents``; where a stage changes a text,
``n_chars`` is its new length. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import bpe, decontamination, language, line_dedup, simhash

#: A text is rejected if it has no letters, or if its words speak for no language by this share.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Learns from the labelled rows of ``docs``; rows predicted ``und`` or below the score go.

    Where nothing is labelled, no language can be told and no row is rejected for it.
    """
    model = language.train(docs)
    d = language.predict(docs, model)
    kept = (F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SCORE) if model.langs else F.lit(True)
    return d.filter(kept).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Texts lose the lines that many documents share; no document goes."""
    d = line_dedup.dedup_lines(docs)
    new = {"text": F.when(F.col("_n_dropped") > 0, F.col("_kept")).otherwise(F.col("text")), "n_chars": F.when(F.col("_n_dropped") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))}
    return d.select(*(new[c].alias(c) if c in new else c for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. One document of each group stays, the one with the smallest id.

    Near-duplicates have a resemblance of 0.8 or more on shingles of five words.
    """
    return simhash.keep_one(docs, simhash.similar_roots(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.exact_matches(docs, items, count_words=False).filter(F.size("_hits") == 0).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. The ids of every text, and the hash of what they decode to."""
    d = bpe.encode(docs, id_cols=("doc_id", "lang", "source"))
    return d.select("doc_id", "lang", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_ids").alias("ids"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode_tokens),
]

#: SQL can't express stages 1, 3 and 5; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

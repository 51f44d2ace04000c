"""The registered queries: thin digests over the operators' real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import avi, bpe, byte_bpe, chat, decontamination, language, license_headers, licenses, line_dedup, periodic_runs, pii, simhash, substring_dedup, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.size("_sentences").cast("long").alias("n_sentences"), F.array_join("_sentences", ",").alias("sentences"), F.array_join("_licenses", ",").alias("licenses"), F.array_join("_expressions", ",").alias("expressions"))


def op1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document below one of the headers and notices of ``license_headers``, told by its id."""
    variant = F.coalesce(F.pmod("doc_id", F.lit(len(license_headers.HEADERS))), F.lit(0))
    text = F.concat(F.get(F.array(*map(F.lit, license_headers.HEADERS)), variant.cast("int")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    d = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", variant.cast("long").alias("variant"), text.alias("text")))
    return d.select("doc_id", "variant", F.array_join(F.array_sort("_licenses"), ",").alias("licenses"))


def op2_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = avi.describe(avi.store_texts(table(spark, sf_dir, "documents")))
    return d.toDF("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of the files that hold the texts: 25 frames a second of 192 bytes each."""
    d = avi.clips(avi.store_texts(table(spark, sf_dir, "documents")))
    return d.select("doc_id", F.col("_clip").alias("clip"), F.col("_start_s").alias("start_s"), F.col("_end_s").alias("end_s"), F.col("_frames").alias("frames"), F.round("_level", 6).alias("level"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.exact_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hits").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


#: Words of a document within which all words of an item must stand.
NEAR = 60


def op3_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), NEAR)
    return d.select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), F.col("_first").cast("long").alias("first_word"), F.col("_last").cast("long").alias("last_word"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)
    return d.toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_group").alias("component_id"))


def in_training(id_col: str = "doc_id"):
    """The rows that language models may learn from; the rest is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, in_training())
    d = language.predict(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chat.collapse_and_render(table(spark, sf_dir, "conversations"))
    return d.select("conv_id", "n_turns", "n_copies", F.octet_length("rendered").cast("long").alias("n_bytes"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("_spans", lambda x: x["kind"].isin(*pii.BASE))
    counts = [F.expr(f"cast(size(filter(_spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    best = F.array_max(F.transform("_spans", lambda x: x["score"]))
    return d.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"), best.alias("best_score"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    d = whitening.whiten(vectors, model)
    explained = F.array(*(F.lit(float(e)) for e in model.explained)) if model else F.lit(None).cast("array<double>")
    d = d.select("vec_id", "_deviation", F.posexplode("_whitened").alias("_at", "whitened"))
    return d.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("_deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = byte_bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)
    return d.toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of one text in ten, told by its id, the rest from some word on repeats with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    d = docs.select("doc_id", "text", words.alias("_w"), F.expr("crc32(cast(doc_id as string)) div 10").alias("_g")).withColumn("_n", F.size("_w"))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    d = d.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    rest = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int"))), F.lit(1), F.col("_n") - F.col("_a"))
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), rest), " ")
    return d.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr("array_sort(_runs, (a, b) -> case when a.length <> b.length then b.length - a.length when a.start <> b.start then a.start - b.start else a.period - b.period end)[0]")
    lines = F.array_join(F.transform("_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = d.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), F.when(F.size("_runs") > 0, longest).alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))
    best = [F.col(f"_best.{c}").cast("long").alias(c) for c in ("start", "length", "period")]
    return d.select("doc_id", "n_runs", *best, F.expr("_best.length * 1000L div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ours = (op1_licenses, op1_headers, op2_avi, op2_clips, op3_decontamination, op3_proximity, op4_bpe, op5_substring_dedup, op6_simhash, op7_language, op8_line_dedup, op9_chat, op10_pii, op11_whitening, op12_byte_bpe, op13_periodic_runs)
    return {f.__name__: f for f in ours}

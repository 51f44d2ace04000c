"""Operator 3, benchmark decontamination: a positional inverted index over the documents.

The index is a stored table of postings (term, document, position), sorted by term within each of its
files: it is written once, without a shuffle, and any number of benchmarks are looked up in it. A
phrase is found from its rarest terms: each list is shifted by the term's place in the phrase, the
shifted lists are intersected, and what is left is confirmed on the lists of all other terms. Only
built-in functions run here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmill.llm.common import ascii_lower, broadcast_if_small, materialise, scratch_root, with_own_names, without_clash

#: What separates words: every ASCII character but 0-9 and, after lower-casing, a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document in the index: its id, and a hash of its text, which keeps rows apart that share an id.
DOC = ["_id", "_th"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def term_of(word: Column | str) -> Column:
    """A term is known by 64 bits of its word."""
    return F.xxhash64(word)


class PositionalIndex:
    """The stored postings ``_term, _id, _th, _pos``; ``path`` reopens an index that was built before."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.path = path
        self.postings = (spark.read.schema(schema) if schema else spark.read).parquet(path)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> PositionalIndex:
        """Writes the postings of all words, to the scratch folder unless ``path`` says where. Documents
        stay where they are read: each task sorts its own postings by term, so that the list of a term
        is a run in every file."""
        path = path or f"{scratch_root(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
        # The hash of a text is made before its words are dealt out, not once for each of them. A last word
        # that is empty stands where the text ends.
        whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.array_append(words_of(F.col(text_col)), F.lit("")).alias("_words"))
        flat = whole.select("_id", "_th", F.posexplode("_words").alias("_pos", "_word"))
        postings = flat.select(term_of("_word").alias("_term"), "_id", "_th", "_pos")
        postings.sortWithinPartitions("_term").write.parquet(path)
        return cls(docs.sparkSession, path, postings.schema)

    def sizes(self) -> DataFrame:
        """``_id, _th, _n``: the number of words of each document."""
        return self.postings.filter(F.col("_term") == term_of(F.lit(""))).groupBy("_id", "_th").agg(F.max("_pos").cast("long").alias("_n"))

    def lists(self, terms: DataFrame) -> DataFrame:
        """The postings of the terms of a written table."""
        return self.postings.join(broadcast_if_small(terms.select("_term").distinct()), "_term", "left_semi")

    def lengths(self, terms: DataFrame) -> DataFrame:
        """``_term, _cf``: how long the list of each term is; terms without postings are left out."""
        return self.lists(terms).groupBy("_term").agg(F.count(F.lit(1)).alias("_cf"))


def phrases(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct word sequences of the items: ``_cid, _terms, _len`` (words in a window) and ``_ids``, the
    items that have it, as sorted strings."""
    i = items.select(F.col(id_col).cast("string").alias("_item"), words_of(F.col(text_col)).alias("_words")).filter(F.size("_words") > 0)
    i = i.filter(F.col("_item").isNotNull()).withColumn("_cid", F.sha2(F.array_join("_words", " "), 256))
    g = i.groupBy("_cid").agg(F.first("_words").alias("_words"), F.sort_array(F.collect_set("_item")).alias("_ids"))
    return g.select("_cid", F.transform("_words", term_of).alias("_terms"), "_ids", F.least(F.lit(window), F.size("_words")).alias("_len"))


def _windows(classes: DataFrame, freq: DataFrame, lists: int) -> DataFrame:
    """``_cid, _start, _rare``: for each window whose terms all have postings, the places in the item
    of its ``lists`` rarest terms."""
    placed = classes.select("_cid", F.posexplode("_terms").alias("_pos", "_term")).join(broadcast_if_small(freq), "_term", "left")
    rated = placed.groupBy("_cid").agg(F.array_sort(F.collect_list(F.struct("_pos", "_cf"))).alias("_rated")).join(classes.select("_cid", "_len"), "_cid")
    w = rated.select("_cid", "_len", "_rated", F.explode(F.expr("sequence(0, size(_rated) - _len)")).alias("_start"))
    w = w.select("_cid", "_start", F.expr("slice(_rated, _start + 1, _len)").alias("_part")).filter(~F.exists("_part", lambda x: x["_cf"].isNull()))
    rare = F.slice(F.array_sort(F.transform("_part", lambda x: F.struct(x["_cf"].alias("c"), x["_pos"].alias("p")))), 1, lists)
    return w.select("_cid", "_start", F.transform(rare, lambda x: x["p"]).alias("_rare"))


def _in_documents(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """The postings of the documents of a written table."""
    d = broadcast_if_small(docs.select(F.col("_id").alias("_wid"), F.col("_th").alias("_wth")).distinct())
    return postings.join(d, postings["_id"].eqNullSafe(d["_wid"]) & (postings["_th"] == d["_wth"]), "left_semi")


def phrase_candidates(index: PositionalIndex, classes: DataFrame, lists: int = 2) -> DataFrame:
    """Alignments ``_id, _th, _cid, _shift``: item word 0 stands at document word ``_shift``, and the
    rarest terms of at least one window of the item stand where they should."""
    terms = materialise(classes.select(F.explode("_terms").alias("_term")).distinct(), "terms")
    freq = materialise(index.lengths(terms), "lengths")
    windows = materialise(_windows(classes, freq, lists), "windows")
    anchors = windows.select("_cid", F.explode("_rare").alias("_place")).distinct().join(classes, "_cid").select("_cid", "_place", F.get("_terms", F.col("_place")).alias("_term"))
    anchors = materialise(anchors, "anchors")
    shifted = index.postings.join(broadcast_if_small(anchors), "_term").select(*DOC, "_cid", (F.col("_pos") - F.col("_place")).alias("_shift"), "_place")
    # Places are bits: one of 64 may stand for several places of a long item, which lets more through.
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    met = shifted.groupBy(*DOC, "_cid", "_shift").agg(F.bit_or(bit(F.col("_place"))).alias("_met"))
    need = F.aggregate("_rare", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))
    needs = materialise(windows.groupBy("_cid").agg(F.collect_set(need).alias("_needs")), "needs")
    return met.join(broadcast_if_small(needs), "_cid").filter(F.exists("_needs", lambda w: w.bitwiseAND(F.col("_met")) == w)).select(*DOC, "_cid", "_shift")


def occurrences(index: PositionalIndex, classes: DataFrame, lists: int = 2) -> DataFrame:
    """``_id, _th, _hits, _ids``: documents with the positions of words inside an occurrence of a window,
    and the items with occurring windows. ``classes`` is a written table of ``phrases``."""
    found = materialise(phrase_candidates(index, classes, lists), "candidates")
    placed = materialise(classes.select("_cid", F.posexplode("_terms").alias("_place", "_term")), "placed")
    # Each word of an aligned item is looked for in its own list, at the one position where it should be.
    should = found.join(broadcast_if_small(placed), "_cid").select(F.col("_id").alias("_aid"), F.col("_th").alias("_ath"), "_cid", "_shift", "_place", F.col("_term").alias("_aterm"), (F.col("_shift") + F.col("_place")).alias("_apos"))
    does = _in_documents(index.lists(placed), found)
    same = should["_aid"].eqNullSafe(does["_id"]) & (should["_ath"] == does["_th"]) & (should["_aterm"] == does["_term"]) & (should["_apos"] == does["_pos"])
    met = should.join(does, same).groupBy(*DOC, "_cid", "_shift").agg(F.sort_array(F.collect_set("_place")).alias("_met"))
    sizes = materialise(classes.select("_cid", "_len", "_ids"), "sizes")
    met = met.join(broadcast_if_small(sizes.drop("_ids")), "_cid")
    # A window occurs where its words are consecutive places: len words on, the place is larger by len.
    met = met.withColumn("_starts", F.expr("filter(transform(_met, (x, i) -> if(get(_met, i + _len - 1) = x + _len - 1, x, null)), x -> x is not null)")).filter(F.size("_starts") > 0)
    met = met.withColumn("_covered", F.expr("array_distinct(flatten(transform(_starts, s -> sequence(_shift + s, _shift + s + _len - 1))))"))
    by_item = met.groupBy(*DOC, "_cid").agg(F.array_distinct(F.flatten(F.collect_list("_covered"))).alias("_covered")).join(broadcast_if_small(sizes.drop("_len")), "_cid")
    return by_item.groupBy(*DOC).agg(F.array_distinct(F.flatten(F.collect_list("_covered"))).alias("_hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("_ids"))


def exact_matches(
    docs: DataFrame, items: DataFrame, window: int = 10, lists: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index: PositionalIndex | None = None, count_words: bool = True
) -> DataFrame:
    """Every row of ``docs`` with ``_n_words`` (unless ``count_words`` is off), ``_hits`` (positions of words inside an occurrence of a
    window, distinct) and ``_items`` (ids, as sorted strings, of the items with occurring windows).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words and no hits; items without words match nothing; items
    of equal words are searched once and all reported; an item id that is null is left out. Repeated
    rows get equal results, rows that share an id but not a text are judged apart. An empty table gives
    an empty table. Other columns pass, whatever their names; one that is named like a result is replaced.

    ``index`` is the stored index of ``docs``; where there is none it is built. The lists are read three
    times: for their lengths, for the rarest terms, and for all terms in documents that these left. The
    texts are not read again.
    """
    index = index or PositionalIndex.build(docs, id_col, text_col)
    classes = materialise(phrases(items, window, item_col, item_text_col), "phrases")
    hits = broadcast_if_small(materialise(occurrences(index, classes, lists), "hits"))
    d, names, new = without_clash(docs, "_n_words", "_hits", "_items")
    i, t = F.col(new[id_col]), F.col(new[text_col])
    d = d.withColumn("_dth", F.xxhash64(t))
    if count_words:
        sizes = index.sizes().withColumnsRenamed({"_id": "_sid", "_th": "_sth"})
        d = d.join(sizes, i.eqNullSafe(sizes["_sid"]) & (F.col("_dth") == sizes["_sth"]), "left")
    d = d.join(hits, i.eqNullSafe(hits["_id"]) & (F.col("_dth") == hits["_th"]), "left")
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    return with_own_names(d, names, new, ({"_n_words": F.col("_n")} if count_words else {}) | {"_hits": F.coalesce("_hits", none[0]), "_items": F.coalesce("_ids", none[1])})


def proximity_matches(
    docs: DataFrame, items: DataFrame, span: int, lists: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index: PositionalIndex | None = None
) -> DataFrame:
    """Pairs ``_id, _item, _first, _last``: the distinct words of the item all stand, in any order,
    within ``span`` consecutive words of the document, from ``_first`` to ``_last`` (the leftmost
    such stretch that starts at one of its words).

    Items without words, or with more distinct words than ``span``, match nothing; null texts have no
    words. Repeated rows of ``docs`` give a pair once. The lists of an item's ``lists`` rarest words are
    met per document first, and the other lists are read only in documents that have all of these.
    """
    index = index or PositionalIndex.build(docs, id_col, text_col)
    classes = phrases(items, span, item_col, item_text_col).withColumn("_set", F.array_distinct("_terms")).filter(F.size("_set") <= span)
    classes = materialise(classes.select("_cid", "_ids", "_set"), "phrases")
    sought = materialise(classes.select("_cid", F.explode("_set").alias("_term"), F.size("_set").alias("_k")), "sought")
    freq = materialise(index.lengths(sought), "lengths")
    rated = sought.join(broadcast_if_small(freq), "_term", "left").groupBy("_cid").agg(F.array_sort(F.collect_list(F.struct("_cf", "_term"))).alias("_rated"))
    rare = rated.filter(~F.exists("_rated", lambda x: x["_cf"].isNull())).select("_cid", F.slice("_rated", 1, lists).alias("_rare")).select("_cid", F.size("_rare").alias("_few"), F.explode("_rare._term").alias("_term"))
    rare = materialise(rare, "rare")
    has = index.lists(rare).select(*DOC, "_term").distinct().join(broadcast_if_small(rare), "_term").groupBy(*DOC, "_cid", "_few").count().filter("count = _few")
    found = materialise(has.select(*DOC, "_cid"), "candidates")
    places = _in_documents(index.lists(sought), found).distinct().join(broadcast_if_small(sought), "_term")
    pairs = found.withColumnsRenamed({"_id": "_fid", "_th": "_fth", "_cid": "_fcid"})
    places = places.join(pairs, places["_id"].eqNullSafe(pairs["_fid"]) & (places["_th"] == pairs["_fth"]) & (places["_cid"] == pairs["_fcid"]), "left_semi")
    ahead = Window.partitionBy(*DOC, "_cid").orderBy("_pos").rangeBetween(0, span - 1)
    starts = places.withColumn("_all", F.size(F.collect_set("_term").over(ahead)) == F.col("_k"))
    first = F.min(F.when(F.col("_all"), F.col("_pos"))).over(Window.partitionBy(*DOC, "_cid"))
    inside = starts.withColumn("_first", first).filter(F.col("_pos").between(F.col("_first"), F.col("_first") + span - 1))
    last = inside.groupBy(*DOC, "_cid", "_first", "_term").agg(F.min("_pos").alias("_pos")).groupBy(*DOC, "_cid", "_first").agg(F.max("_pos").alias("_last"))
    return last.join(broadcast_if_small(classes.select("_cid", "_ids")), "_cid").select("_id", "_first", "_last", F.explode("_ids").alias("_item"))

"""Operators against plain versions, on tables with nulls, ties, repeats, long texts and odd columns."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute, plain_jpeg

from trailmill.llm import avi, bpe, chat, decontamination, language, licenses, line_dedup, pii, simhash, substring_dedup
from trailmill.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lines string, _fp string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("the", "ber", "él", "on", "tr", "Qu") for b in ("a", "e", "in", "ou", "ß", "st", "x1")]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, line = text(40), "A line that many documents share here."
    docs: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "\n\n")]
    for i in range(5, n):
        parts = [text(r.randint(1, 50)) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(0, line.upper() if i % 2 else f"  {line}\r")
        if i % 5 == 0:
            parts.append(passage)
        if i % 7 == 0 and docs[-1][1]:
            parts = docs[-1][1].split("\n")
        docs.append((i, "\n".join(parts)))
    docs.append((n, text(6000) + "\n" + passage + "\n" + line))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def own_columns(df, *names):
    return df.withColumns({c: F.lit("own") for c in names})


def test_line_dedup(spark, docs):
    names = ("_lines", "_id", "_th", "_h1", "_by", "_pos", "_n_lines")
    out = line_dedup.dedup_lines(own_columns(frame(spark, docs), *names))
    got = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["_kept"]) for r in out.collect()}
    assert got == brute.line_dedup(docs)
    assert any(v[1] for v in got.values())
    assert len(set(out.columns)) == len(out.columns) and {r["_id"] + r["_by"] for r in out.collect()} == {"ownown"}


@pytest.mark.parametrize("share", [0, 1 << 30])
def test_line_dedup_frequent_lines_change_nothing(spark, docs, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "SHARE", share)
    got = {r["doc_id"]: (r["_n_lines"], r["_n_dropped"], r["_kept"]) for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert got == brute.line_dedup(docs)


def test_line_dedup_repeated_rows_and_empty(spark, docs):
    d = frame(spark, docs[:20])
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    both = line_dedup.dedup_lines(d.union(d)).collect()
    assert len(both) == 40
    null = spark.createDataFrame([(None, "x" * 30), (1, "x" * 30), (2, "x" * 30)], "doc_id long, text string")
    assert {r["doc_id"]: r["_kept"] for r in line_dedup.dedup_lines(null).collect()} == {None: "", 1: "", 2: "x" * 30}


def test_decontamination(spark, docs):
    long = docs[10][1] or ""
    items = [(1, docs[-1][1].split("\n")[1]), (2, "thea berin"), (3, ""), (4, None), (5, "nothing of this occurs anywhere in the texts at all ever"), (None, "thea"), (6, long[:200]), (7, docs[-1][1].split("\n")[1]), (8, "thea " * 12)]
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.exact_matches(own_columns(frame(spark, docs), "_id", "_w", "_th", "_hits", "_cid"), b)
    got = {r["doc_id"]: (r["_n_words"], sorted(r["_hits"]), r["_items"]) for r in out.collect()}
    assert got == brute.decontaminate(docs, items)
    assert any(v[2] for v in got.values())
    assert len(set(out.columns)) == len(out.columns) and {r["_id"] + r["_w"] for r in out.collect()} == {"ownown"}


def test_decontamination_index_serves_several_benchmarks(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    decontamination.PositionalIndex.build(frame(spark, docs), path=path)
    index = decontamination.PositionalIndex(spark, path)
    for items in ([(1, docs[10][1][:150])], [(2, docs[-1][1].split("\n")[1]), (3, "thea")]):
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {r["doc_id"]: (r["_n_words"], sorted(r["_hits"]), r["_items"]) for r in decontamination.exact_matches(frame(spark, docs), b, index=index).collect()}
        assert got == brute.decontaminate(docs, items)


def test_decontamination_empty_tables_and_repeated_rows(spark, docs):
    b = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.exact_matches(frame(spark, docs), b).collect()
    assert len(got) == len(docs) and all(r["_hits"] == [] and r["_items"] == [] for r in got)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.exact_matches(frame(spark, []), some).count() == 0
    rows = [(7, "x a b"), (7, "x a b"), (7, "b a"), (None, "a b a b"), (None, None)]
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["_n_words"], sorted(r["_hits"])) for r in decontamination.exact_matches(spark.createDataFrame(rows, "doc_id long, text string"), some).collect())
    assert got == [(0, "", 0, []), (0, "a b a b", 4, [0, 1, 2, 3]), (7, "b a", 2, []), (7, "x a b", 3, [1, 2]), (7, "x a b", 3, [1, 2])]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x b y c"), (2, "a x x x x x x b c"), (3, "c b a"), (3, "c b a"), (4, None), (5, "x a a b b c c b a")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "a b c"), ("j", "zz a"), ("k", None)], "item_id string, text string")
    got = sorted((r["_id"], r["_item"], r["_first"], r["_last"]) for r in decontamination.proximity_matches(d, b, 5).collect())
    assert got == [(1, "i", 0, 4), (3, "i", 0, 2), (5, "i", 1, 5)]
    assert decontamination.proximity_matches(d.limit(0), b, 5).count() == 0


def test_proximity_clashing_names_and_a_very_long_text(spark):
    """An item that stands once, far inside a text of 60 000 words, whose words all occur elsewhere as well, apart."""
    words = ["w%d" % (k % 977) for k in range(60_000)]
    for k, w in ((10, "alpha"), (20_000, "beta"), (40_000, "gamma"), (50_001, "gamma"), (50_003, "alpha"), (50_004, "beta")):
        words[k] = w
    names = ("_id", "_term", "_at", "_tv", "_cid", "_item")
    d = own_columns(spark.createDataFrame([(1, " ".join(words)), (2, "beta gamma"), (None, "gamma alpha beta")], "doc_id long, text string"), *names)
    b = own_columns(spark.createDataFrame([(7, "Alpha, beta gamma!"), (None, "alpha")], "item_id long, text string"), *names)
    got = [(r["_id"], r["_item"], r["_first"], r["_last"]) for r in decontamination.proximity_matches(d, b, 4).collect()]
    assert sorted(got, key=str) == sorted([(1, "7", 50_001, 50_004), (None, "7", 0, 2)], key=str)


def substring_rows(df):
    return {r["doc_id"]: (r["_n_words"], r["_n_removed"], r["_kept"]) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup(spark, docs, batches):
    """Also with columns of clashing names, one batch or several, compacted on the way."""
    want = brute.substring_dedup(docs)
    clash = frame(spark, docs).withColumns({c: F.lit("own") for c in ("_id", "_key", "_at", "_text", "_kept")})
    assert substring_rows(substring_dedup.dedup_substrings(clash, batches, 1)) == want
    assert any(v[1] for v in want.values())
    assert substring_dedup.dedup_substrings(frame(spark, []), batches).count() == 0


def test_substring_frequent_fingerprints_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 1)
    monkeypatch.setattr(substring_dedup, "SAMPLE", 2)
    d = frame(spark, docs)
    assert substring_dedup.frequent_fingerprints(d)
    assert substring_rows(substring_dedup.dedup_substrings(d, 3, 1)) == brute.substring_dedup(docs)


def test_substring_index_compacts_and_joins_without_exchange(spark, docs, tmp_path):
    """Four batches one after another, with runs merged between, give what one batch gives."""
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path), max_runs=2)
    got, after = {}, None
    for hi in (15, 25, 35, 45, 99):
        got |= substring_rows(substring_dedup.dedup_batch(frame(spark, [x for x in docs if x[0] < hi]), index, after))
        after = hi - 1
    assert got == brute.substring_dedup(docs)
    assert len(index.runs) == 3
    a, b = (spark.table(r) for r in index.runs[:2])
    plan = a.join(b.select("_key").distinct().hint("merge"), "_key", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_substring_index_outlives_its_session(spark, docs, tmp_path):
    """Each batch opens the index anew, as a later application would, with nothing left in the catalog."""
    got, ids = {}, sorted(i for i, _ in docs)
    borders = [None, ids[20], ids[40], None]
    for after, upto in zip(borders, borders[1:], strict=False):
        index = substring_dedup.FingerprintIndex.open(spark, str(tmp_path / "index"), max_runs=1)
        seen = [x for x in docs if upto is None or x[0] <= upto]
        got |= substring_rows(substring_dedup.dedup_batch(frame(spark, seen), index, after))
        names = index.runs
        index.close()
        assert not {t.name for t in spark.catalog.listTables()} & set(names)
    assert got == brute.substring_dedup(docs)
    again = substring_dedup.FingerprintIndex.open(spark, str(tmp_path / "index"))
    assert again.runs == names and 0 < len(again.runs) <= 2 and again.spark.table(again.runs[-1]).count() > 0
    again.close()


def test_substring_ids_of_any_kind(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("b", text), ("a", "x " + text), (None, "y " + text), ("a", "other " * 3 + text), ("c", None), ("c", ""), ("b", text)]
    got = sorted((r["doc_id"] or "", r["_n_words"], r["_n_removed"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", 31, 0), ("a", 31, 30), ("a", 33, 30), ("b", 30, 30), ("b", 30, 30), ("c", 0, 0), ("c", 0, 0)]


def test_simhash(spark, docs):
    near = [*docs, *((100 + i, (docs[-1][1] or "") + f" word{i}") for i in range(40)), (200, docs[9][1])]
    got = {r["doc_id"]: (r["_fp"] % (1 << 64), r["_group"]) for r in simhash.near_duplicate_groups(frame(spark, near)).collect()}
    fp = {i: brute.simhash(t) for i, t in near}
    group = brute.components(fp)
    assert got == {i: (fp[i], group[i]) for i, _ in near}
    assert len(set(group.values())) < len(near)


def test_simhash_repeats_and_empty(spark):
    d = spark.createDataFrame([(2, "a b c d e"), (2, "a b c d e"), (1, "a b c d e"), (None, "zz yy"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["_group"]) for r in simhash.near_duplicate_groups(d).collect())
    assert [g for g in got if g[0] > 0] == [(1, 1), (2, 1), (2, 1), (7, 7), (8, 7)]
    assert simhash.near_duplicate_groups(d.limit(0)).count() == 0


def test_similar_groups_keep_one(spark):
    r = random.Random(5)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(400)] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):
        c = list(b)
        c[100 + i] = "changed"
        rows.append((100 + i, " ".join(c)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash.keep_one(d, simhash.similar_groups(d)).collect()}
    assert kept == set(range(30))


def resemblance(a: str, b: str) -> float:
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def changed(r: random.Random, words: list[str], share: float) -> list[str]:
    """A copy of about that resemblance: words replaced, each in five shingles of its own."""
    n = len(words) - 4
    at = sorted(r.sample(range(1, len(words) // 5 - 1), round(n * (1 - share) / (1 + share) / 5)))
    return [f"new{r.random()}" if i % 5 == 2 and i // 5 in at else w for i, w in enumerate(words)]


def test_similar_groups_planted_pairs(spark):
    r = random.Random(6)
    rows, pairs = [], []
    for k, share in enumerate([0.6, 0.65, 0.7, 0.75, 0.78, 0.82, 0.85, 0.9, 0.95] * 12):
        a = [f"w{r.randint(0, 50000)}" for _ in range(600)]
        b = changed(r, a, share)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append((2 * k, 2 * k + 1, resemblance(rows[-2][1], rows[-1][1])))
    got = {x["doc_id"]: x["_group"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [p for p in pairs if p[2] < 0.8 and got[p[0]] == got[p[1]]]
    assert not [p for p in pairs if p[2] >= 0.85 and got[p[0]] != got[p[1]]]
    limit = [got[a] == got[b] for a, b, s in pairs if 0.8 <= s < 0.85]
    assert limit and sum(limit) >= 0.9 * len(limit)


def test_similar_groups_repeated_phrase_and_star(spark):
    r = random.Random(7)
    text = lambda n: [f"w{r.randint(0, 50000)}" for _ in range(n)]
    phrase = " ".join(text(5))
    rows = [(1, " ".join([phrase] * 200 + text(100))), (2, " ".join([phrase] * 200 + text(100)))]
    body = text(300)
    rows += [(3, " ".join(body)), (4, " ".join([*body, *[phrase] * 200]))]  # alike in distinct shingles
    # Copies of one original, each at 0.82 of it and at less than 0.8 of each other.
    origin = text(600)
    rows += [(i, " ".join(changed(r, origin, 0.82))) for i in range(100, 220)] + [(220, " ".join(origin))]
    assert resemblance(rows[4][1], rows[5][1]) < 0.8 <= resemblance(rows[4][1], rows[-1][1])
    got = {x["doc_id"]: x["_group"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [1, 2, 3, 3]
    assert {got[i] for i in range(100, 221)} == {100}


def test_keep_one_null_and_repeated_ids(spark):
    r = random.Random(8)
    t = [" ".join(f"w{r.randint(0, 50000)}" for _ in range(200)) for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1] + " end"), (5, t[2]), (5, t[3]), (5, t[3]), (None, t[4]), (9, t[4] + " end"), (5, t[5]), (3, t[5] + " end")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("_th", "_fp", "_group", "_kid")})
    for groups in (simhash.similar_groups(d), simhash.near_duplicate_groups(d, radius=10)):
        found = simhash.keep_one(d, groups)
        assert found.columns == d.columns and {x["_th"] + x["_kid"] for x in found.collect()} == {"ownown"}
        kept = [(x["doc_id"], x["text"]) for x in found.collect()]
        one_of_two = [x for x in kept if x in rows[1:3]]
        assert len(one_of_two) == 1
        assert {x for x in kept if x not in one_of_two} == {rows[0], rows[3], rows[4], rows[7], rows[9]}
        assert len(kept) == 7  # the rows equal in id and text stay together


def near_values(seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    one = lambda: np.uint64(1) << r.integers(0, 64, 900, dtype=np.uint64)
    return np.unique(np.concatenate([r.integers(0, 2**63, 600, dtype=np.uint64), one() | one()]))


def partition(n: int, pairs) -> set[frozenset[int]]:
    group = list(range(n))
    for a, b in pairs:
        x, y = group[a], group[b]
        if x != y:
            group = [x if g == y else g for g in group]
    return {frozenset(i for i in range(n) if group[i] == g) for g in set(group)}


def plain_partition(values: np.ndarray) -> set[frozenset[int]]:
    got = brute.components(dict(enumerate(values.tolist())))
    return {frozenset(i for i in got if got[i] == g) for g in set(got.values())}


def test_bk_forest_links_all_components_through_trees():
    v = near_values(0)
    shard = np.repeat([0, 3, 4], [len(v) - 10, 1, 9])
    a, b, forest = simhash.forest_links(v.reshape(-1, 1), shard, 4)
    assert (np.bitwise_count(v[a] ^ v[b]) <= 4).all() and (shard[a] == shard[b]).all()
    for s in (0, 3, 4):
        at = np.flatnonzero(shard == s)
        inside = [(x - at[0], y - at[0]) for x, y in zip(a.tolist(), b.tolist(), strict=True) if shard[x] == s]
        assert partition(len(at), inside) == plain_partition(v[at])
    # Every link was found by a walk over nodes, and the walks left most of the pairs out.
    assert len(forest.levels) > 5 and len(a) <= forest.visited < len(v) ** 2 / 4
    for node in np.flatnonzero(forest.above >= 0)[:200]:
        same = np.flatnonzero(forest.above == forest.above[node])
        assert len({int(np.bitwise_count(v[x] ^ v[forest.above[node]])) for x in same}) == len(same)


def test_bk_forest_asks_other_part():
    v = near_values(1)
    np.random.default_rng(2).shuffle(v)
    asks = np.arange(len(v)) % 3 == 0
    a, b, _ = simhash.forest_links(v.reshape(-1, 1), np.zeros(len(v), int), 4, asks)
    own = np.flatnonzero(asks)
    c, d, _ = simhash.forest_links(v[own].reshape(-1, 1), np.zeros(len(own), int), 4)
    links = [*zip(a.tolist(), b.tolist(), strict=True), *zip(own[c].tolist(), own[d].tolist(), strict=True)]
    assert partition(len(v), links) == plain_partition(v)


@pytest.mark.parametrize("part", [20_000, 70])
def test_shards_in_one_part_or_several(spark, part):
    v = near_values(3)
    fps = spark.createDataFrame([(int(x) - (1 << 64) if x >> np.uint64(63) else int(x),) for x in v], "_fp long")
    keyed = simhash.keyed_by_blocks(fps, 4, 1)
    links = [(r["_a"] % (1 << 64), r["_b"] % (1 << 64)) for r in simhash.shard_links(keyed, keyed, 4, part, 1).collect()]
    at = {int(x): i for i, x in enumerate(v)}
    assert partition(len(v), [(at[a], at[b]) for a, b in links]) == plain_partition(v)
    assert len(simhash.dealt_in_parts(keyed, keyed, part, 1).select("_block").distinct().collect()) > (0 if part > 1000 else 3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    alphabet = ["a", "e", "i", "n", "t", "th", "é", " ", "  ", "\n", "1", "!", "0", "ß", "你", "😀", "́", "-", "=", "<|endoftext|>"]
    odd = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    return [None, "", "<|endoftext|>", "a" * 70, "ab" * 5000, " " * 300, "I'll DON'T we're", *odd]


def test_bpe_equals_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(d).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["_ids"], "<u4").tolist() == ids
        assert (got[i]["_n_tokens"], got[i]["_ids_sha256"], got[i]["_decoded_sha256"]) == (len(ids), brute.ids_sha(ids), brute.sha(t.decode(ids, skip_special_tokens=False)))
    assert bpe.encode(d.limit(0)).count() == 0


def test_bpe_repeated_rows_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    long = "long words, " * 60_000
    d = own_columns(spark.createDataFrame([(1, "same text"), (1, "same text"), (None, long)], "doc_id long, text string"), "_text", "_ids", "_n_tokens")
    got = bpe.encode(d)
    assert got.columns == ["doc_id", "_n_tokens", "_ids", "_ids_sha256", "_decoded_sha256"]
    assert sorted((r["doc_id"] or 0, r["_n_tokens"]) for r in got.collect()) == sorted([(1, len(t.encode("same text").ids))] * 2 + [(0, len(t.encode(long).ids))])


def test_language(spark):
    r = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "berg", "tz"], "cc": ["éx", "oùi", "ça"]}
    word = lambda x: "".join(r.choice(syllables[x]) for _ in range(r.randint(1, 5)))
    rows = [(i, " ".join(word(x) for _ in range(40)), x) for i, x in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 ?!", "cc"), (903, "ka lo", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(d, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = {x["doc_id"]: (x["_lang_pred"], x["_score"]) for x in language.predict(d, m).collect()}
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    held = [(i, x) for i, _, x in rows[:120] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 20 and sum(got[i][0] == x for i, x in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_equals_plain(spark):
    r = random.Random(12)
    stems = {"aa": ["kal", "om", "thi", "é"], "bb": ["kal", "sch", "erg", "om"], "cc": ["thi", "sch", "ça", "lu"]}
    word = lambda x: "".join(r.choice(stems[x]) for _ in range(r.randint(1, 3)))
    rows = [(i, " ".join(word(x) for _ in range(r.randint(1, 12))), x) for i, x in enumerate(["aa", "bb", "cc"] * 12)]
    asked = [(100 + i, t, None) for i, t in enumerate(["kalom thischlu", "unbekannt", "zzz 12", "KAL om, om!", "", "qqq", "ça " * 3000])]
    d = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string").withColumn("_score", F.lit("own"))
    out = language.predict(d, language.train(d))
    assert out.columns == ["doc_id", "text", "lang", "_lang_pred", "_score"]
    got = {x["doc_id"]: (x["_lang_pred"], x["_score"]) for x in out.union(out).collect()}
    want = brute.language(rows, rows + asked)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)
    assert language.predict(d.limit(0), language.train(d)).count() == 0


def test_language_ties_and_without_labels(spark):
    d = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    r = language.predict(d, language.train(d)).first()
    assert (r["_lang_pred"], r["_score"]) == ("und", 0.0)
    tie = spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert {x["_lang_pred"] for x in language.predict(tie, language.train(tie)).collect()} == {"x"}


def test_avi_round_trip(spark, docs):
    d = frame(spark, docs)
    got = {r["doc_id"]: r for r in avi.describe(avi.store_texts(d)).collect()}
    for i, t in docs:
        raw = (t or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r["_n_bytes"], r["_payload_bytes"], r["_payload_sha256"], r["_tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))


def test_avi_repeated_rows_and_clashing_columns(spark):
    d = own_columns(spark.createDataFrame([(1, "text"), (1, "text"), (None, "z" * 300_000)], "doc_id long, text string"), "_media", "_text", "_feature")
    stored = avi.store_texts(d)
    assert stored.columns == ["doc_id", "_n_bytes", "_media"]
    rows = [tuple(r) for r in avi.describe(stored.withColumn("_feature", F.lit("own"))).collect()]
    assert len(rows) == 3 and len(set(rows)) == 2 and all("own" not in r for r in rows)
    assert avi.store_texts(d.limit(0)).count() == 0


def test_usual_code_tables():
    """Codes that the standard lists."""
    table = {t: {s: format(c, f"0{n}b") for s, (c, n) in avi.canonical_codes(avi.USUAL[t][0], avi.usual_symbols(t)).items()} for t in avi.USUAL}
    assert [table[0x00][k] for k in (0, 5, 11)] == ["00", "110", "111111110"]
    assert [table[0x01][k] for k in (0, 2, 11)] == ["00", "10", "11111111110"]
    assert [table[0x10][k] for k in (0x00, 0xF0, 0x01, 0x03, 0x11, 0x31, 0xFA)] == ["1010", "11111111001", "00", "100", "1100", "111010", "1111111111111110"]
    assert [table[0x11][k] for k in (0x00, 0xF0, 0x01, 0x02, 0x11, 0xFA)] == ["00", "1111111010", "01", "100", "1011", "1111111111111110"]


USUAL_AC = [(avi.USUAL[t][0], list(avi.usual_symbols(t))) for t in (0x10, 0x11)]


@pytest.mark.parametrize("how", ["grey", "colour", "no tables", "restarts", "odd size"])
def test_avi_decodes_frames_of_another_writer(how):
    r = np.random.default_rng(3)
    h, w = (37, 45) if how == "odd size" else (32, 48)
    y, x = np.mgrid[0:h, 0:w]
    luma = [np.clip(128 + 60 * np.sin(x / 5 + k) + 50 * np.cos(y / 7) + r.normal(0, 6, (h, w)), 0, 255).astype(np.uint8) for k in range(3)]
    small = np.full((-(-h // 2), -(-w // 2)), 90, np.uint8)
    frames = []
    for p in luma:
        if how in ("grey", "restarts"):
            frames.append(plain_jpeg.write([p], [(1, 1)], USUAL_AC, restart=5 if how == "restarts" else 0))
        else:
            frames.append(plain_jpeg.write([p, small, small], [(2, 2), (1, 1), (1, 1)], USUAL_AC, tables=how != "no tables", restart=2 if how == "odd size" else 0))
    files = [plain_jpeg.avi(frames), plain_jpeg.avi(frames, absolute=True), plain_jpeg.avi(frames, index=False), plain_jpeg.avi(frames, index=False, grouped=True)]
    for fps, samples, number in avi.decode_files(files):
        assert fps == 10 and number.tolist() == [0, 1, 2] and samples.shape == (3, h * w)
        off = np.abs(samples.astype(int) - np.stack(luma).reshape(3, -1))
        assert off.max() <= 6 and off.mean() < 1.0


def test_avi_shots_of_pictures(spark):
    r = np.random.default_rng(4)
    picture = lambda level: np.clip(r.normal(level, 10, (16, 16)), 0, 255).astype(np.uint8)
    frames = [plain_jpeg.write([picture(v)], [(1, 1)], USUAL_AC, tables=False) for v in [40] * 8 + [200] * 6]
    frames[3] = b""  # repeats the frame before
    d = spark.createDataFrame([(1, bytearray(plain_jpeg.avi(frames))), (1, bytearray(plain_jpeg.avi(frames)))], "_level long, _media binary")
    got = sorted((x["_clip"], x["_start_s"], x["_end_s"], x["_frames"]) for x in avi.clips(d).collect())
    assert got == [(0, 0.0, 0.8, 8), (0, 0.0, 0.8, 8), (1, 0.8, 1.4, 6), (1, 0.8, 1.4, 6)]
    assert avi.clips(d.limit(0)).count() == 0 and avi.describe(d.limit(0)).count() == 0


def test_avi_shots_and_bad_files(spark):
    r = np.random.default_rng(1)
    shots = np.concatenate([np.full((30, 192), 20), np.full((25, 192), 200), np.full((40, 192), 90)]) + r.integers(0, 3, (95, 192))
    data = avi.write_avi(avi.encode_frames(shots.astype(np.uint8)))
    assert (avi.decode_files([data])[0][1] == shots).all()
    no_index = data[: data.rindex(b"idx1")]
    rows = [(1, data), (2, None), (3, b"RIFFjunk"), (4, data[: len(data) // 2]), (5, no_index), (6, b"")]
    d = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in rows], "id long, _media binary")
    got = [(x["id"], x["_start_s"], x["_frames"]) for x in avi.clips(d).orderBy("id", "_clip").collect()]
    assert [g for g in got if g[0] == 1] == [(1, 0.0, 30), (1, 1.2, 25), (1, 2.2, 40)]
    assert [g[1:] for g in got if g[0] == 5] == [g[1:] for g in got if g[0] == 1]
    assert not {2, 3, 6} & {g[0] for g in got}
    assert avi.describe(d).count() == 6


def test_pii_equals_patterns(spark):
    r = random.Random(4)
    bits = ["a.b+c@x-y.com", "a@b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "++1 234 567 8901", "12345678901234567890", " ", "\n", "word", "é", "."]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 14)))) for i in range(400)] + [(900, None), (901, "9" * 3000), (902, "x" * 5000 + "@a.b")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["_spans"] if s["kind"] in pii.BASE] for x in pii.find_pii(d).collect()}
    assert got == {i: brute.pii(t) for i, t in rows}


def kinds(spark, text, *kind):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(s["kind"], text[s["start"] : s["end"]], s["score"]) for s in pii.find_pii(d).first()["_spans"] if s["kind"] in kind]


def test_pii_in_a_very_long_text(spark):
    """Spans at both ends and in the middle of a text of a million characters, also across where it might be cut."""
    filler = "words and é numbers 12 34, no data here; " * 12_000
    parts = ["me@example.org", "4111 1111 1111 1111", "192.168.0.1", "+1 (555) 123-4567"]
    text = " . ".join([parts[0], filler, parts[1], filler, " . ".join(parts), filler[:999], parts[2], parts[3]])
    got = [(s["kind"], s["start"], s["end"]) for s in pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["_spans"] if s["kind"] in pii.BASE]
    assert len(text) > 900_000 and got == brute.pii(text) and len(got) == 8


def test_pii_validators_context_and_redaction(spark):
    good = "DE89 3704 0044 0532 0130 00"
    assert kinds(spark, f"my bank account {good} please", "iban") == [("iban", good, 0.8)]
    assert kinds(spark, f"plainly {good}.", "iban") == [("iban", good, 0.6)]
    assert kinds(spark, f"the serial {good}", "iban") == []  # a word against it takes it away
    assert kinds(spark, "DE88370400440532013000 and DE8937040044053201300 and DE893704004405320130000", "iban") == []  # checksum, too short, too long
    assert kinds(spark, "490154203237518", "imei") == []
    assert kinds(spark, "the imei is 49-015420-323751-8, it is", "imei") == [("imei", "49-015420-323751-8", 0.6)]  # a word for it brings it
    # Only whole words count: neither hotel nor recall speak of a phone.
    assert kinds(spark, "hotel recall +49 30 1234567", "phone")[0][2] == 0.6 and kinds(spark, "Tel. +49 30 1234567", "phone")[0][2] == 0.8
    d = spark.createDataFrame([(3, "mail me: a@b.org, or example a@b.org", "own", "own"), (3, "mail me: a@b.org, or example a@b.org", "own", "own")], "doc_id long, text string, _spans string, _c0 string")
    out = pii.find_pii(d, redact=True)
    assert out.columns == ["doc_id", "text", "_c0", "_spans", "_redacted"]
    assert [x["_redacted"] for x in out.collect()] == ["mail me: [email], or example [email]"] * 2
    assert pii.find_pii(d.limit(0)).count() == 0


MIT_FILE = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_HEADER = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
LGPL_HEADER = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
"""
GPL_HEADER = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
BSD_FILE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_licenses(spark):
    rows = [
        (1, "Intro words.\nReleased under the MIT License.\nEnd."),
        (2, APACHE_HEADER),
        (3, "Licensed under CC BY-NC 4.0.\nAll rights reserved.\nLicensed under CC BY-NC 4.0."),
        (4, None),
        (5, ""),
        (6, "Permission granted to nobody. Redistribution and use in source and binary forms."),
        (7, "x " * 200_000 + ".\n" + MIT_FILE),
        (8, LGPL_HEADER),
        (9, GPL_HEADER + BSD_FILE),
        (10, "// SPDX-License-Identifier: GPL-2.0-only\nint main;"),
        (10, "// SPDX-License-Identifier: GPL-2.0-only\nint main;"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("_left", "_ids", "_licenses")})
    out = licenses.scan_licenses(d)
    assert out.columns == ["doc_id", "text", "_left", "_ids", "_sentences", "_licenses", "_expressions"] and {x["_left"] for x in out.collect()} == {"own"}
    got = {x["doc_id"]: (len(x["_sentences"]), x["_licenses"]) for x in out.collect()}
    assert got == {1: (1, ["MIT"]), 2: (5, ["Apache-2.0"]), 3: (3, ["CC-BY-NC-4.0"]), 4: (0, []), 5: (0, []), 6: (0, []), 7: (4, ["MIT"]), 8: (3, ["LGPL-2.1-or-later"]), 9: (5, ["BSD-2-Clause", "GPL-3.0-or-later"]), 10: (1, ["GPL-2.0-only"])}
    assert out.count() == len(rows) and licenses.scan_licenses(d.limit(0)).count() == 0


def test_license_rules_equal_plain(spark):
    r = random.Random(9)
    known, rules = licenses.DEFAULT.sentences, licenses.DEFAULT.rules
    said = {v: k for k, v in known.items()} | {"Says.MIT": "released under the mit license", "Says.Zlib": "this file is licensed under the zlib license see license"}
    rows = []
    for i in range(120):
        seq = []
        for _ in range(r.randint(0, 4)):
            seq += list(r.choice(rules)[1]) if r.random() < 0.7 else [r.choice(list(said))]
        rows.append((i, "\n\n".join(f"Note {k}.\n\n{said[x].capitalize()}." for k, x in enumerate(seq))))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(x["_licenses"]) > 1 for x in got) > 20
    phrases = sorted({x for x in said if x.startswith("Says.")})
    for x in got:
        want = brute.licenses(x["_sentences"], [*rules, *((p[5:], (p,)) for p in phrases)])
        assert x["_licenses"] == (want or (["Proprietary"] if x["_sentences"] and "Rights.reserved" in x["_sentences"] else [])), x["doc_id"]


def told(spark, texts, rules=licenses.DEFAULT):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(x["_licenses"], x["_expressions"]) for x in licenses.scan_licenses(d, rules=rules).orderBy("doc_id").collect()]


def test_license_expressions(spark):
    cases = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": (["Apache-2.0", "MIT"], ["MIT OR Apache-2.0"]),
        "/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) */": (["BSD-3-Clause", "GPL-2.0-only"], ["(GPL-2.0-only OR BSD-3-Clause)"]),
        "# SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\nand more": (["GPL-2.0-only WITH Linux-syscall-note"], ["GPL-2.0 WITH Linux-syscall-note"]),
        "-- SPDX-License-Identifier: GPL-2.0-or-later AND (MIT or ISC)\nlower": (["GPL-2.0-or-later", "ISC", "MIT"], ["GPL-2.0-or-later AND (MIT or ISC)"]),
        "SPDX-License-Identifier: LicenseRef-Ours and MIT": (["MIT"], ["LicenseRef-Ours and MIT"]),
        "<!-- SPDX-License-Identifier: LGPL-2.1+ -->\n<!-- SPDX-License-Identifier: zlib. -->": (["LGPL-2.1-or-later", "Zlib"], ["LGPL-2.1+", "zlib."]),
        "SPDX-License-Identifier:": ([], []),
        "Apache-2.0": ([], []),
    }
    assert told(spark, cases) == list(cases.values())


def test_license_phrases_and_rights(spark):
    cases = {
        "Licensed under the MIT license, see LICENSE.": ["MIT"],
        "The source code is made available under the terms of the GPLv3+.": ["GPL-3.0-or-later"],
        "This project is licensed under the Apache License, Version 2.0 - see the LICENSE file for details.": ["Apache-2.0"],
        "This dataset is published under a CC BY 4.0 license": ["CC-BY-4.0"],
        "Released under pressure. We were licensed under protest.": [],
        "Copyright 2020. All rights reserved.\n": ["Proprietary"],
        "All rights reserved.\n" + BSD_FILE: ["BSD-2-Clause"],
        "All rights reserved.\nLicensed under the MIT License.": ["MIT"],
    }
    assert [x for x, _ in told(spark, cases)] == list(cases.values())


@pytest.mark.parametrize(("file", "name"), [("GPL-3", "GPL-3.0-only"), ("GPL-2", "GPL-2.0-only"), ("LGPL-3", "LGPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("Apache-2.0", "Apache-2.0")])
def test_license_files(spark, file, name):
    """Whole license files, as a system has them: told by the rules built in, and as whole texts when given as such."""
    path = f"/usr/share/common-licenses/{file}"
    if not os.path.exists(path):
        pytest.skip("no license files here")
    text = open(path, encoding="utf-8").read()
    assert name in told(spark, [text])[0][0]
    rules = licenses.DEFAULT.with_texts({"The-Text": text})
    whole, first, second = told(spark, [f"Preface.\n\n{text}\n\nThe end.", text[: len(text) // 2], text[len(text) // 2 :]], rules)
    assert whole[0] == ["The-Text"] and "The-Text" in first[0] and "The-Text" not in second[0]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "lost"), (6, 0, "assistant", None), (7, 0, None, "assistant")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: (x["n_turns"], x["n_copies"], x["rendered"]) for x in chat.collapse_and_render(t).collect()}
    assert set(got) == {2, 4, 5, 6, 7}
    assert got[2] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")
    assert got[5][2] == "<|im_start|>\n<|im_end|>\n"
    assert chat.collapse_and_render(t.limit(0)).count() == 0


def test_chat_long_and_clashing(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}", "own") for k in range(400)]
    rows = [*turns, *((2, *t[1:]) for t in turns[:399]), *((3, *t[1:]) for t in turns), (4, 0, "user", "y" * 200_000, "own")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _n string").withColumn("_line", F.lit("own"))
    got = {x["conv_id"]: (x["n_turns"], x["n_copies"], len(x["rendered"])) for x in chat.collapse_and_render(d).collect()}
    assert set(got) == {1, 4} and got[1][:2] == (400, 2) and got[4][2] > 200_000
    assert chat.collapse_and_render(d).columns == ["conv_id", "n_turns", "n_copies", "rendered"]

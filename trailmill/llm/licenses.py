"""Operator 1, license scans: known sentences become identifiers, and ordered rules match their sequences.

Only built-in functions run here, row by row: there is no shuffle. Three kinds of sentences are known: those of
license texts and notices, phrases that name a license ("Licensed under the .."), and tags with an
expression of license names, each of whose terms becomes an identifier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm import license_texts
from trailmill.llm.common import ascii_lower, with_own_names, without_clash

#: A line break before a small letter, an opening bracket, a quote or a word of a license's name continues
#: a sentence, as does one between capitals; comment marks at the start of such a line go. Other
#: breaks, and marks before a blank, end it.
CONTINUES, IN_CAPITALS = r"\r?\n[ \t]*(?://+|[*#;]+|--)?[ \t]*([a-z(\"]|(?:Licenses?|General|Lesser|Affero|Public|Foundation|Free Software)\b)", r"([A-Z,)\"])[ \t]*\r?\n[ \t]*(?://+|[*#;]+|--)?[ \t]*([A-Z][A-Z])"
#: A tag and the expression after it, whole: names, exceptions and brackets, on one line.
_TERM = r"(?:\([ \t]*)*[A-Za-z0-9][A-Za-z0-9.:+-]*(?:[ \t]*\))*"
TAGGED = rf"{license_texts.TAG}:[ \t]*({_TERM}(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+{_TERM})*)"
ENDS, OTHER = r"[.!?;:]+[ \t]+|[\r\n]+", r"[^a-z0-9.+\n]+"
#: A phrase that names a license, as normalised; what follows the name points to a file or tells more.
_WHAT, _HOW = "|".join(license_texts.THINGS), "|".join(license_texts.WAYS)
PHRASE = rf"^(?:(?:this|the) (?:{_WHAT}) (?:is|are) )?(?:{_HOW}) under (?:a |the )?(?:terms of (?:a |the )?)?(.+?)(?: licen[sc]e)?(?:(?: please)? (?:see|refer to|which|as found|found|a copy|included|copyright) .*)?$"
#: What the identifier of a phrase, of a tag's term and of a rights line begins with.
SAYS, RIGHTS = "Says.", "Rights.reserved"
TAG_WORDS = "spdx license identifier "


def normal(sentence: str) -> str:
    """A sentence as it is compared: lower case, runs of other characters than a-z, 0-9, dot and plus as one blank."""
    return re.sub(OTHER, " ", sentence.lower()).strip(" .")


def sentences_in(text: str) -> list[str]:
    """The normalised sentences of a text, as ``sentences_of`` has them."""
    t = re.sub(IN_CAPITALS, r"\1 \2", re.sub(CONTINUES, r" \1", text))
    return [s for s in (normal(x) for x in re.sub(ENDS, "\n", t.lower()).split("\n")) if s]


@dataclass
class Rules:
    """Identifiers of normalised sentences, and rules in the order in which they are tried: whole texts, the longest
    first, then their cores."""

    sentences: dict[str, str] = field(default_factory=dict)
    rules: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def with_texts(self, texts: dict[str, str], core: int = 3) -> Rules:
        """These rules and those of further whole license texts: all their sentences, and their first ``core`` ones."""
        new = Rules(dict(self.sentences), list(self.rules))
        for name, text in texts.items():
            ids = tuple(new.sentences.setdefault(s, f"{name}.text.{k}") for k, s in enumerate(sentences_in(text), 1))
            new.rules += [(name, ids), (name, ids[:core])]
        new.rules = sorted(dict.fromkeys(r for r in new.rules if r[1]), key=lambda r: -len(r[1]))
        return new


def _known() -> Rules:
    known: dict[str, str] = {}
    whole, cores = [], []
    for name, text in license_texts.TEXTS.items():
        lines = [normal(x) for x in text.strip().split("\n")]
        ids = tuple(known.setdefault(x, f"{name.replace(' ', '_')}.{k}") for k, x in enumerate(lines, 1))
        license_name = name.removesuffix(" text")
        license_name = license_texts.TEXT_NAMES.get(license_name, license_name)
        whole.append((license_name, ids))
        if name in license_texts.CORES:
            cores.append((license_name, ids[: license_texts.CORES[name]]))
    longest = lambda rules: sorted(rules, key=lambda r: -len(r[1]))
    known |= {normal(x): f"{SAYS}{name}" for x, name in license_texts.OTHERS.items()} | {normal(x): RIGHTS for x in license_texts.RIGHTS}
    return Rules(known, [*longest(whole), *longest(cores)])


DEFAULT = _known()
NAMES = {normal(n).removesuffix(" license"): name for n, name in license_texts.NAMES.items()}
TERMS = {normal(n): n for n in license_texts.SPDX} | {normal(a): b for a, b in license_texts.OLD_SPDX.items()}
EXCEPTIONS = {normal(n): n for n in license_texts.EXCEPTIONS}


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def sentences_of(text: Column) -> Column:
    """Normalised sentences; a tag and its expression are one of them."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.contains(t, F.lit(license_texts.TAG)), F.regexp_replace(t, TAGGED, f"\n{license_texts.TAG} $1\nEnd. ")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, CONTINUES, " $1"), IN_CAPITALS, "$1 $2")
    t = F.regexp_replace(F.regexp_replace(ascii_lower(t), ENDS, "\n"), OTHER, " ")
    return F.split(t, "\n")


def _terms_of(expression: Column) -> Column:
    """Identifiers of the known terms of a normalised expression, each with its exception."""
    found = F.split(expression, " or (?!later)| and ")

    def one(term: Column) -> Column:
        parts = F.split(F.trim(term), " with ", 2)
        base, extra = F.try_element_at(_table(TERMS), F.trim(parts[0])), F.try_element_at(_table(EXCEPTIONS), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))))
        return F.concat(F.lit(SAYS), base, F.when(extra.isNull(), "").otherwise(F.concat(F.lit(" WITH "), extra)))

    return F.transform(found, one)


def identifiers_of(sentences: Column, rules: Rules = DEFAULT) -> Column:
    """Identifiers of the known sentences in order; the others are passed over."""
    lengths = sorted({len(s) for s in rules.sentences})
    known = _table(rules.sentences)
    none = F.array().cast("array<string>")

    def of(s: Column) -> Column:
        named = F.try_element_at(_table(NAMES), F.regexp_extract(s, PHRASE, 1))
        phrase = F.when(F.contains(s, F.lit(" under ")) & F.rlike(s, F.lit(PHRASE)), F.array(F.concat(F.lit(SAYS), named)))
        return (
            F.when(F.startswith(s, F.lit(TAG_WORDS)), _terms_of(F.substring(s, len(TAG_WORDS) + 1, 1 << 30)))
            .when(F.length(s).isin(lengths) & F.try_element_at(known, s).isNotNull(), F.array(F.try_element_at(known, s)))
            .otherwise(F.coalesce(phrase, none))
        )

    bare = F.transform(sentences, lambda s: F.trim(s, F.lit(" .")))
    likely = lambda s: F.length(s).isin(lengths) | F.contains(s, F.lit(" under ")) | F.startswith(s, F.lit(TAG_WORDS))
    return F.array_compact(F.flatten(F.transform(F.filter(bare, likely), of)))


def _matches(ids: Column, rules: Rules) -> Column:
    """Every place where a rule fits, by the order of the rules and of the places: struct(k, at, n, name)."""
    by_first: dict[str, list[Column]] = {}
    for k, (name, seq) in enumerate(rules.rules):
        rule = F.struct(F.lit(k).alias("k"), F.lit(len(seq)).alias("n"), F.lit(name).alias("name"), F.array(*map(F.lit, seq)).alias("ids"))
        by_first.setdefault(seq[0], []).append(rule)
    table = F.create_map(*(x for first, found in by_first.items() for x in (F.lit(first), F.array(*found))))
    no_rule = F.slice(F.array(*next(iter(by_first.values()))), 1, 0)

    def at(first: Column, i: Column) -> Column:
        fits = F.filter(F.coalesce(F.try_element_at(table, first), no_rule), lambda r: F.slice(ids, i + 1, r["n"]) == r["ids"])
        return F.transform(fits, lambda r: F.struct(r["k"].alias("k"), i.alias("at"), r["n"].alias("n"), r["name"].alias("name")))

    return F.array_sort(F.flatten(F.transform(ids, at)))


def _told(ids: Column, rules: Rules) -> Column:
    """Names: those of the rules in their order, each place used once, then those of phrases and tags by name."""
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, m: Column) -> Column:
        places = F.sequence(m["at"], m["at"] + m["n"] - 1)
        more = F.struct(F.concat(acc["used"], places).alias("used"), F.concat(acc["names"], F.array(m["name"])).alias("names"))
        return F.when(F.arrays_overlap(acc["used"], places), acc).otherwise(more)

    def finish(acc: Column) -> Column:
        free = F.filter(ids, lambda x, i: F.startswith(x, F.lit(SAYS)) & ~F.array_contains(acc["used"], i))
        said = F.array_sort(F.transform(free, lambda x: F.substring(x, len(SAYS) + 1, 1 << 30)))
        names = F.array_distinct(F.concat(acc["names"], said))
        return F.when((F.size(names) == 0) & F.array_contains(ids, RIGHTS), F.array(F.lit(license_texts.RESERVED))).otherwise(names)

    return F.aggregate(_matches(ids, rules), start, step, finish)


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: Rules = DEFAULT) -> DataFrame:
    """Every row of ``docs`` with ``_sentences`` (identifiers in order), ``_licenses`` (names, each once: of the
    rules in their order, then of phrases and tags by name) and ``_expressions`` (after tags, as written).

    A rule matches identifiers that follow one another, whatever unknown sentences stand between them; every
    place is used by the first rule that fits. An exception belongs to the name of its license. Reserved rights tell
    something only where no license is told. ``rules`` may hold further texts (``Rules.with_texts``). Null and
    empty texts have none of the three; repeated rows get equal results; an empty table stays empty. Other
    columns pass, whatever their names; one that is named like a result is replaced.
    """
    docs, names, new = without_clash(docs, "_sentences", "_licenses", "_expressions")
    text = F.coalesce(F.col(new[text_col]), F.lit(""))
    d = docs.withColumn("_ids", identifiers_of(sentences_of(text), rules))
    none = F.array().cast("array<string>")
    told = F.when(F.size("_ids") == 0, none).otherwise(_told(F.col("_ids"), rules))
    expressions = F.when(F.contains(text, F.lit(license_texts.TAG)), F.regexp_extract_all(text, F.lit(TAGGED), F.lit(1))).otherwise(none)
    return with_own_names(d, names, new, {"_sentences": F.col("_ids"), "_licenses": told, "_expressions": expressions})

"""Operator 10, personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed. The first four are the base: every
#: confirmed span of them is listed, whatever its score.
KINDS = ("email", "ip", "card", "phone", "iban", "imei")
BASE = KINDS[:4]
#: Score of a confirmed span before its context is read. Of the other kinds a span is listed
#: only at ``LEAST`` or more: a device number needs a word for it nearby, an account number none against it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "imei": 0.4}
LEAST = 0.5
#: Words that raise or lower the score when they stand, as words, within ``REACH`` characters.
CONTEXT = {
    "email": (("mail", "email", "contact", "write"), ("example",)),
    "ip": (("ip", "address", "host", "server", "login"), ("version", "release", "section")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "payment"), ("isbn", "order", "serial", "tracking")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "whatsapp"), ("isbn", "version")),
    "iban": (("iban", "account", "bank", "transfer"), ("serial", "part", "model")),
    "imei": (("imei", "device", "handset"), ("card", "visa", "mastercard")),
}
REACH = 40
STEP = 0.2
#: How many characters an international account number has in each country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is taken whole or not at all, so neither pattern tries a run twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IMEI = re.compile(r"(?<![0-9])[0-9]{2}(?:-?[0-9]{6}){2}-?[0-9](?![0-9])")
_NO_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(code: str) -> bool:
    """The check of international account numbers: country and check digits go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards over the local part: leftmost matches without a scan of every word."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many letters and digits as the country has, in groups that a blank may part, up to where a word ends."""
    for m in _IBAN.finditer(text):
        size, code, at = IBAN_LENGTHS.get(m[0][:2], 0), [], m.start()
        while len(code) < size and at < len(text):
            c = text[at]
            if c.isascii() and (c.isdigit() or c.isupper()):
                code.append(c)
            elif c != " " or text[at - 1] == " ":
                break
            at += 1
        if size and len(code) == size and not text[at : at + 1].isalnum() and mod97("".join(code)):
            yield m.start(), at


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """Confirmed spans (kind, start, end, score) by start, then kind; code points, end exclusive."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    found += [("iban", s, e) for s, e in _ibans(text)]
    found += [("imei", *m.span()) for m in _IMEI.finditer(text) if luhn(_NO_DIGIT.sub("", m[0]))]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    rated = [(k, s, e, _score(text, k, s, e)) for k, s, e in found]
    return [x for x in rated if x[0] in BASE or x[3] >= LEAST]


def _score(text: str, kind: str, start: int, end: int) -> float:
    """A word counts if it stands whole within reach: what is cut off at the border does not."""
    before, after = text[max(0, start - REACH - 1) : start].lower(), text[end : end + REACH + 1].lower()
    near = {w[0] for w in _WORD.finditer(before) if w.start() or start <= REACH} | {w[0] for w in _WORD.finditer(after) if w.end() <= REACH}
    for_it, against = CONTEXT[kind]
    score = PRIOR[kind] + STEP * (not near.isdisjoint(for_it)) - STEP * (not near.isdisjoint(against))
    return round(min(1.0, max(0.0, score)), 2)


def find_pii(docs: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``_spans``, an array of (kind, start, end, score), and with ``redact``
    ``_redacted``, the text with each stretch of spans replaced by the kind of its first, in brackets.

    A null or empty text has no spans (and an empty ``_redacted``); spans of different kinds may
    overlap; repeated rows get equal results; an empty table stays empty; other columns pass, one that
    is named like a result is replaced. Rows are read where they lie, there is no shuffle.
    """
    kind = "array<struct<kind:string,start:long,end:long,score:double>>"
    more = {"_spans": kind} | ({"_redacted": "string"} if redact else {})
    docs = docs.drop(*more)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    at = docs.columns.index(text_col)
    schema = d.selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t in more.items())).schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, clean = [], []
            for t in b.column(at):
                text = t.as_py() or ""
                found = spans_of(text)
                spans.append([dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in found])
                if redact:
                    out, done = [], 0
                    for k, s, e, _ in found:
                        if s >= done:
                            out += [text[done:s], f"[{k}]"]
                        done = max(done, e)
                    clean.append("".join([*out, text[done:]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, arrow), *([pa.array(clean, pa.string())] if redact else [])], names=[*names, *more])

    return d.mapInArrow(run, schema).toDF(*docs.columns, *more)

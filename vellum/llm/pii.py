"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, digits beside digits or dots,
schemes and identifier cues; parsers without backtracking expand each anchor to its span's borders and validate it.

Base kinds, each leftmost and without overlap: ``email``, ``ip``, ``card``, ``phone``. The method's own: ``iban`` (check digits valid),
``login`` (user and password in a URL's authority), ``secret`` (the value behind a cue such as ``token =`` or ``password:``). Offsets are
code points, the end exclusive.

Edge cases: null texts are empty; texts of any length are scanned whole; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "login", "secret")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access_key")
LEAST_SECRET = 8
#: How many digits and letters an IBAN has, by the country codes it may begin with, here at large: 15 to 34.
IBAN_LENGTH = (15, 34)

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_PHONE = frozenset(" ().0123456789-")
_SECRET = re.compile(r"[\"']?[ \t]*(?::=|=|:)[ \t]*([\"'`]?)([A-Za-z0-9_+/=.~-]+)")

FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"


@cache
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for x in "0123456789":
        for y in "0123456789":
            a.add_word(f"{x}.{y}", ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(f"{x}{gap}{y}", ("card", 2 + len(gap)))
    a.add_word("://", ("login", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("secret", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def email_at(text: str, at: int, low: int) -> tuple[int, int] | None:
    """The address around the at-sign, not beginning before low."""
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels, n = at + 1, 0, len(text)
    while True:
        stop = end
        while stop < n and text[stop] in _HOST:
            stop += 1
        if stop == end:  # a dot without a label behind it is not part of the address
            end -= 1
            break
        labels, end = labels + 1, stop
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def digits_around(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1] in _DIGITS:
        at -= 1
    return at


def ips_at(text: str, at: int, low: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Matches in the chain of dotted digits around a digit: four parts each; and the chain's end."""
    start, n = digits_around(text, at, low), len(text)
    while start - 1 > low and text[start - 1] == "." and text[start - 2] in _DIGITS and start - 2 >= low:
        start = digits_around(text, start - 1, low)
    parts, end = [], start
    while True:
        stop = end
        while stop < n and text[stop] in _DIGITS:
            stop += 1
        parts.append((end, stop))
        if stop + 1 < n and text[stop] == "." and text[stop + 1] in _DIGITS:
            end = stop + 1
        else:
            break
    out = []
    for i in range(0, len(parts) - 3, 4):
        some = parts[i : i + 4]
        out.append((some[0][0], some[3][1], all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in some)))
    return out, parts[-1][1]


def card_at(text: str, at: int, low: int) -> tuple[int, int]:
    """The chain of digits, at most one space or hyphen between two, around a digit."""
    start, end, n = at, at, len(text)
    while start > low and (text[start - 1] in _DIGITS or start - 1 > low and text[start - 1] in " -" and text[start - 2] in _DIGITS):
        start -= 1 if text[start - 1] in _DIGITS else 2
    while end < n and (text[end] in _DIGITS or end + 1 < n and text[end] in " -" and text[end + 1] in _DIGITS):
        end += 1 if text[end] in _DIGITS else 2
    return start, end


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    n = len(text)
    if at + 1 >= n or text[at + 1] not in _DIGITS:
        return None
    end = at + 2
    while end < n and text[end] in _PHONE:
        end += 1
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return IBAN_LENGTH[0] <= len(code) <= IBAN_LENGTH[1] and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    low = dict.fromkeys(KINDS, 0)
    iban_from = -1
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "email":
            if at >= low[kind] and (span := email_at(text, at, low[kind])):
                out[kind].append(span)
                low[kind] = span[1]
        elif kind == "phone":
            if at >= low[kind] and (span := phone_at(text, at)):
                low[kind] = span[1]
                if 8 <= sum(c in _DIGITS for c in text[slice(*span)]) <= 15:
                    out[kind].append(span)
        elif kind == "ip":
            if at >= low[kind]:
                spans, low[kind] = ips_at(text, at, low[kind])
                out[kind] += [(a, b) for a, b, ok in spans if ok]
        elif kind == "card":
            if at >= low[kind]:
                span = card_at(text, at, low[kind])
                low[kind] = span[1]
                digits = text[slice(*span)].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out[kind].append(span)
            if at >= 2 and at > iban_from and text[at - 2 : at].isascii() and text[at - 2 : at].isupper() and (m := _IBAN.match(text, at - 2)):
                iban_from = m.end()
                if iban_valid(m[0]):
                    out["iban"].append(m.span())
        elif kind == "login":
            stop = at + 3
            while stop < len(text) and not text[stop].isspace() and text[stop] not in "/?#\"'<>":
                stop += 1
            user, sign, _ = text[at + 3 : stop].rpartition("@")
            if sign and ":" in user.strip(":") and at >= low[kind]:
                out[kind].append((at + 3, at + 3 + len(user)))
                low[kind] = stop
        elif last >= low[kind] and (m := _SECRET.match(text, last + 1)) and len(m[2]) >= LEAST_SECRET:
            out[kind].append(m.span(2))
            low[kind] = m.end()
    return [(kind, a, b) for kind in KINDS for a, b in out[kind]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span as its kind in brackets; overlapping spans become one, by the first kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: its key as doc_id, and FOUND."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(docs.sparkSession, f"doc_id long, {FOUND}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                spans = scan(t or "")
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [{"kind": k, "start": a, "end": b} for k, a, b in spans]))
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(find, f"doc_id long, {FOUND}")


def mask_pii(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span in the text masked; all columns keep their names, types and order. Null texts stay null."""
    small_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index(text.lower())
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    kind = plain.schema[at].dataType.simpleString()
    plain = plain.withColumn(inner[at], F.col(inner[at]).cast("string"))
    schema = plain.schema

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [t if t is None else masked(t, s) if (s := scan(t)) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    return plain.mapInArrow(mask, schema).withColumn(inner[at], F.col(inner[at]).cast(kind)).toDF(*docs.columns)

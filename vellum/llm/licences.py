"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates expressions.

Notice phrases are found in the sequence of words, so any separators may stand between them. Behind an identifier tag
(``SPDX-License-Identifier:``) stands an expression of identifiers, ``AND``, ``OR``, ``WITH``, ``+`` and parentheses; the longest
beginning of the line's rest that is one (behind an opening quote, if any) is parsed into postfix form and evaluated twice: to the labels of its identifiers, and to whether
the licences it asks for are permitted (``AND``: both, ``OR``: either, ``WITH``: the licence's own answer).

Edge cases: null texts are empty; an empty text has no words, no labels and score 0; a tag that no expression follows gives the
label ``unparsed``; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow_schema, small_batches

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own phrases: label and weight of evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9), "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9), "bsd license": ("bsd", 0.8), "isc license": ("isc", 0.8), "boost software license": ("bsl", 0.9),
    "cc by nc": ("cc-by-nc", 0.9), "cc by sa": ("cc-by-sa", 0.9), "cc by nd": ("cc-by-nd", 0.9), "cc0 1 0": ("cc0", 0.9), "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.5), "all rights reserved": ("reserved", 0.7),
    "permission is hereby granted free of charge": ("mit", 0.9), "redistribution and use in source and binary forms": ("bsd", 0.9),
}
TAGS = ("spdx-license-identifier:", "spdx license identifier:")
BASE_WEIGHT, TAG_WEIGHT = 0.9, 0.99
#: Families of identifiers that an expression may use without asking, and the beginnings of identifiers by label.
PERMITTED = frozenset({"mit", "apache", "bsd", "isc", "bsl", "cc0", "cc-by", "public-domain", "unlicense", "zlib"})
FAMILIES = (("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"), ("mpl", "mpl"), ("epl", "epl"), ("bsl", "bsl"), ("unlicense", "unlicense"), ("zlib", "zlib"))

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:-]*\+?))")
_BINDS = {"or": 1, "and": 2, "with": 3}

FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean, spans array<struct<label:string,word:long>>"


class ExpressionError(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: postfix order of an expression's identifiers and operators, all in lower case."""
    out: list[str] = []
    stack: list[str] = []
    at, operand_next = 0, True
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r}")
        at = m.end()
        token = (m[1] or m[2]).lower()
        if token == "(":
            if not operand_next:
                raise ExpressionError("a parenthesis after an operand")
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ExpressionError("an operator without an operand")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError("a parenthesis that nothing opens")
            stack.pop()
        elif token in _BINDS:
            if operand_next:
                raise ExpressionError("an operator without an operand")
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ExpressionError("two operands in a row")
            out.append(token)
            operand_next = False
    if operand_next:
        raise ExpressionError("an operand is missing")
    while stack:
        if stack[-1] == "(":
            raise ExpressionError("a parenthesis that nothing closes")
        out.append(stack.pop())
    return out


def parsed_beginning(text: str) -> list[str]:
    """Postfix form of the longest beginning of text that is an expression. Operators and operands must take turns, so it ends at the first token that can't follow."""
    ends, at, operand_next, depth = [], 0, True, 0
    while m := _TOKEN.match(text, at):
        token = (m[1] or m[2]).lower()
        if token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif token in _BINDS:
            if operand_next:
                break
            operand_next = True
        elif operand_next:
            operand_next = False
        else:
            break
        at = m.end()
        if not operand_next and not depth:
            ends.append(at)
    if not ends:
        raise ExpressionError("no operand")
    return to_postfix(text[: ends[-1]].rstrip(".:-"))


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return next((label for start, label in FAMILIES if name.startswith(start)), name)


def evaluate(postfix: list[str], permitted: frozenset[str] = PERMITTED) -> tuple[frozenset[str], bool]:
    """The labels of an expression's licences, and whether they are permitted. What stands behind ``with`` is an exception, not a licence."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix:
        if token in _BINDS:
            (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
            stack.append((a, a_ok) if token == "with" else (a | b, a_ok and b_ok if token == "and" else a_ok or b_ok))
        else:
            label = label_of(token)
            stack.append((frozenset({label}), label in permitted))
    return stack[0]


@cache
def automaton():  # noqa: ANN201
    """Phrases with a space before, between and behind their words; tags lie in an automaton of their own."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in BASE.items():
        phrases.add_word(f" {phrase} ", (phrase, label, BASE_WEIGHT, True))
    for phrase, (label, weight) in NOTICES.items():
        phrases.add_word(f" {phrase} ", (phrase, label, weight, False))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str) -> tuple:
    """The columns of FOUND for a text."""
    phrases, tags = automaton()
    low = text.translate(LOWER)
    words = WORD.findall(low)
    line = f" {' '.join(words)} "
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    spans: list[tuple[str, int]] = []
    miss = 1.0
    starts: list[int] = []  # where each word stands in the line, once there is a match
    for end, (phrase, label, weight, is_base) in phrases.iter(line):
        starts = starts or list(accumulate((len(w) + 1 for w in words[:-1]), initial=1))
        word = bisect_left(starts, end - len(phrase))  # the match opens with the space behind the word before, at end - len(phrase) - 1
        spans.append((label, word))
        labels.add(label)
        miss *= 1 - weight
        if is_base:
            base.append(word)
            base_labels.add(label)
    expressions, permitted = [], None
    for end, _ in tags.iter(low) if "spdx" in low else ():
        stop = low.find("\n", end)
        raw = text[end + 1 : stop if stop >= 0 else len(text)].lstrip(" \t\"'`*")
        try:
            postfix = parsed_beginning(raw)
            found, ok = evaluate(postfix)
            expressions.append(" ".join(postfix))
        except ExpressionError:
            found, ok = frozenset({"unparsed"}), False
        labels |= found
        permitted = ok if permitted is None else permitted and ok
        miss *= 1 - TAG_WEIGHT
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - miss, expressions, permitted, [{"label": a, "word": b} for a, b in sorted(spans, key=lambda x: (x[1], x[0]))]


def licences(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: its key as doc_id, and FOUND."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(docs.sparkSession, f"doc_id long, {FOUND}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(scan(t or "") for t in batch.column(1).to_pylist()), strict=True)) or [[] for _ in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(made, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(find, f"doc_id long, {FOUND}")

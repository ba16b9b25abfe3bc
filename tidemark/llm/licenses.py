"""Licence scans: Aho-Corasick over words finds identifier tags and notice phrases; licence expressions are evaluated by a
shunting-yard parser.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and anything outside ASCII. A phrase occurs where its
words stand one after the other; all places count, overlapping ones too. The automaton runs over the words joined by single
spaces, so one pass finds all phrases, and a place's word number is the number of spaces before it.

``SPDX-License-Identifier:`` tags are read with the expression that follows them: identifiers, parentheses, AND, OR, WITH
(binding in that order from weakest OR to strongest WITH, any letter case). ``evaluate`` gives an expression's labels and
whether it permits reuse under ``PERMISSIVE``. The score is the probability-like weight of evidence: 1 - product of (1 -
weight) over the distinct labels found, between 0 and 1.

Defined results: a null or empty text has no words, no places, empty label strings and score 0; a malformed expression
keeps the labels of all identifiers before the place where the parser stops, and the label ``malformed``; repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrase and label. Fixed values.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of this operator's own: words and label.
MORE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by-notice",
    "public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "no part of this publication may be reproduced": "no-copying",
}
TAG = "spdx license identifier"
WEIGHTS = {"reserved": 0.5, "public-domain": 0.5, "cc-by": 0.7, "malformed": 0.2}
OTHER_WEIGHT = 0.9
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "cc-by-4.0", "zlib"})
#: Every byte that separates words becomes a space; letters are lower-cased first. Bytes over 127 belong to words.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?")
_TAGGED = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n\r]*)", re.IGNORECASE | re.ASCII)
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>, permissive boolean"


def fold_words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Malformed(ValueError):
    """``labels``: the identifiers up to the place where the parser stopped."""

    def __init__(self, why: str, out: list[str]):
        super().__init__(why)
        self.labels = [x for x in out if x not in _RANK]


def parse(expression: str) -> list[str]:
    """Reverse Polish form of a licence expression; Malformed, a ValueError, if it is that."""
    out, ops, want, last = [], [], True, ""  # want: an operand comes next
    for token in _TOKEN.findall(expression):
        word, before, last = token.upper(), last, token
        if word in _RANK:
            if want:
                raise Malformed(f"{token} without a left side", out)
            if word == "WITH" and (before == ")" or ops and ops[-1] == "WITH"):
                raise Malformed("WITH takes a single licence", out)
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[word]:
                out.append(ops.pop())
            ops.append(word)
            want = True
        elif token == "(":
            if not want:
                raise Malformed("( after an operand", out)
            if ops and ops[-1] == "WITH":
                raise Malformed("WITH takes a single exception", out)
            ops.append(token)
        elif token == ")":
            if want:
                raise Malformed(") without an operand", out)
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise Malformed("unbalanced )", out)
            ops.pop()
        elif want:
            out.append(token.lower())
            want = False
        else:
            break  # prose after the expression
    if want or "(" in ops:
        raise Malformed("it ends early", out)
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[list[str], bool]:
    """The licence labels of an expression, and whether some choice that it offers is permissive throughout."""
    stack: list[tuple[list[str], bool]] = []
    for token in parse(expression):
        if token not in _RANK:
            stack.append(([token], token in PERMISSIVE))
            continue
        (b, yes_b), (a, yes_a) = stack.pop(), stack.pop()
        if token == "WITH":
            stack.append(([f"{a[-1]} with {b[0]}", *a[:-1]], yes_a))  # an exception only adds permissions
        else:
            stack.append((a + b, yes_a or yes_b if token == "OR" else yes_a and yes_b))
    return stack[0]


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {**BASE_PHRASES, **MORE_PHRASES, TAG: ""}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan_text(text: str) -> dict:
    """All that the operator reports on one text."""
    words = fold_words(text)
    joined = " " + b" ".join(words).decode() + " "
    starts, labels, base, expressions = [], set(), set(), []
    at, number, permissive = 0, -1, None
    for end, phrase in _automaton().iter(joined):
        if phrase in BASE_PHRASES:
            start = end - len(phrase) - 1  # the space before the phrase
            number += joined.count(" ", at, start + 1) if start + 1 >= at else -joined.count(" ", start + 1, at)
            at = start + 1
            starts.append(number)
            base.add(BASE_PHRASES[phrase])
        elif phrase == TAG:
            expressions = [m.strip() for m in _TAGGED.findall(text)]
        else:
            labels.add(MORE_PHRASES[phrase])
    for expression in expressions:
        try:
            found, free = evaluate(expression)
            permissive = free if permissive is None else permissive and free
        except Malformed as e:
            found = [*e.labels, "malformed"]
        labels.update(x.replace(",", " ") for x in found)
    rest = 1.0
    for label in sorted(labels | base):
        rest *= 1 - WEIGHTS.get(label, OTHER_WEIGHT)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts) if starts else None,
        "last_word": max(starts) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels | base)),
        "score": 1 - rest,
        "expressions": expressions,
        "permissive": permissive,
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string()), "permissive": pa.bool_()}
    for batch in batches:
        found = [scan_text(x or "") for x in batch.column("text").to_pylist()]
        names = ["n_words", "n_base", "first_word", "last_word", *kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[n] for x in found], kinds.get(n, pa.int64())) for n in names)], names=["doc_id", *names])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``, by SCHEMA; no shuffle."""
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_scan, SCHEMA)

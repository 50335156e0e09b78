"""Operator 5: license scans.

One Aho-Corasick automaton per worker finds, in the document's words joined by single spaces,
notice phrases and the words of the identifier tag. The expression of each tag, of which a line may hold several, is read from the
raw text by a shunting-yard parser (``with`` binds tighter than ``and``, ``and`` tighter than
``or``) and evaluated: every identifier's permissiveness, ``and`` the least, ``or`` the best.

A document's words are the runs of ASCII letters and digits and of non-ASCII characters after
A-Z are lower-cased, so phrases match over line breaks and punctuation.

Defined results: null and empty texts have no words, no labels and score 0; a malformed
expression (unbalanced, missing operand) still gives the labels of its identifiers and scores as
if they were joined by ``and``; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

#: Phrases whose places count as base places, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases that add labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: How freely text under a label may be used, 0 to 1; a label not named here counts as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "bsl-1": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "mpl-2": 0.7, "epl": 0.7, "lgpl": 0.6, "lgpl-2": 0.6, "lgpl-3": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4,
    "agpl": 0.3, "agpl-3": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.05,
}
UNKNOWN = 0.5

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: The tag as the automaton finds it, with any separators.
_TAG_RAW = re.compile(r"(?<![0-9A-Za-z\x80-\U0010ffff])spdx[^0-9A-Za-z\x80-\U0010ffff]+license[^0-9A-Za-z\x80-\U0010ffff]+identifier(?![0-9A-Za-z\x80-\U0010ffff])", re.I | re.A)
_SEPARATORS = re.compile(r"[^0-9A-Za-z(\x80-\U0010ffff]*")
_LINE = re.compile(r"[^\r\n]*")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """A license identifier's label: lower case, without ``-only``, ``-or-later``, ``+`` and trailing zero versions."""
    x = identifier.lower().rstrip("+")
    x = re.sub(r"-(only|or-later)$", "", x)
    x = re.sub(r"(?<=\d)(\.0)+$", "", x)
    x = re.sub(r"^bsd-\d.*$|^0bsd$", "bsd", x)
    x = re.sub(r"^(cc-by(?:-nc|-sa|-nd)?)(?:-.*)?$", r"\1", x)
    return re.sub(r"^cc0.*$", "cc0", x)


def _cut(expression: str) -> list[str]:
    """The tokens that belong to an expression at the start of a line: it ends where two operands meet without an operator."""
    out: list[str] = []
    depth, operand = 0, False
    for t in _TOKEN.findall(expression):
        low = t.lower()
        if low in _RANK:
            if not operand:
                break
            out.append(low)
            operand = False
        elif t == "(":
            if operand:
                break
            depth += 1
            out.append(t)
        elif t == ")":
            if depth == 0:
                break
            depth -= 1
            out.append(t)
            operand = True
        else:
            if operand:
                break
            out.append(t.rstrip(".:"))
            operand = True
    return out


def evaluate(expression: str) -> tuple[list[str], float | None, bool]:
    """(labels, score or None if there is none, well formed) of a license expression, by shunting-yard."""
    tokens = _cut(expression)
    out: list[tuple[float, bool]] = []
    ops: list[str] = []
    labels: list[str] = []
    well = True

    def apply() -> bool:
        op = ops.pop()
        if op == "(" or len(out) < 2:
            return False
        (b, _), (a, _) = out.pop(), out.pop()
        out.append((a if op == "with" else min(a, b) if op == "and" else max(a, b), False))
        return True

    after_with = False
    for t in tokens:
        if t in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                well &= apply()
            ops.append(t)
            after_with = t == "with"
        elif t == "(":
            ops.append(t)
            after_with = False
        elif t == ")":
            while ops and ops[-1] != "(":
                well &= apply()
            if ops:
                ops.pop()
            else:
                well = False
        else:
            if after_with:  # the exception's name is an operand but no license
                out.append((1.0, True))
            else:
                labels.append(label_of(t))
                out.append((FREEDOM.get(labels[-1], UNKNOWN), False))
            after_with = False
    while ops:
        if ops[-1] == "(":
            ops.pop()
            well = False
        else:
            well &= apply()
    well = well and len(out) == 1
    if not labels:
        return [], None, False
    return labels, out[0][0] if well else min(FREEDOM.get(x, UNKNOWN) for x in labels), well


def tag_expressions(text: str) -> Iterator[str]:
    """What follows each tag, to the end of its line or the next tag. A tag whose line holds nothing more takes the next line that does. There, and
    without a colon or an equals sign, words may be no expression: they are one if the first identifier is known or the line is a whole expression."""
    tags = list(_TAG_RAW.finditer(text))
    for k, m in enumerate(tags):
        stop = tags[k + 1].start() if k + 1 < len(tags) else len(text)
        between = _SEPARATORS.match(text, m.end(), stop)
        line = _LINE.match(text, between.end(), stop)[0]
        sure = not re.search(r"[\r\n]", between[0]) and re.search("[:=]", between[0])
        if sure or FREEDOM.get((evaluate(line)[0] or [""])[0]) is not None or evaluate(line)[2] and len(_cut(line)) == len(_TOKEN.findall(line)):
            yield line


_automaton = None


def _machine():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for phrase in {*BASE, *NOTICES, TAG}:
            _automaton.add_word(f" {phrase} ", phrase)
        _automaton.make_automaton()
    return _automaton


def scan(text: str | None) -> dict:
    """What one document holds: words, base places, labels, score and the tags' expressions."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_KEEP).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[int] = []
    base: set[str] = set()
    notices: set[str] = set()
    tagged = False
    at = before = 0  # spaces are counted once, from hit to hit
    for end, phrase in _machine().iter(joined):
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE:
            before += joined.count(" ", at, end)
            at = end
            places.append(before - phrase.count(" ") - 1)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            notices.add(NOTICES[phrase])
    labels = base | notices
    scores = [FREEDOM.get(x, UNKNOWN) for x in labels]
    expressions = []
    if tagged:
        for expression in tag_expressions(text or ""):
            got, value, _ = evaluate(expression)
            if value is not None:
                expressions.append(" ".join(_cut(expression)))
                labels |= set(got)
                scores.append(value)
    return {"n_words": len(words), "places": places, "base": base, "labels": labels, "score": min(scores, default=0.0), "expressions": expressions}


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([r["places"] for r in rows], pa.list_(pa.int64())),
                pa.array([sorted(r["base"]) for r in rows], pa.list_(pa.string())),
                pa.array([sorted(r["labels"]) for r in rows], pa.list_(pa.string())),
                pa.array([r["score"] for r in rows], pa.float64()),
                pa.array([r["expressions"] for r in rows], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "places", "base", "labels", "score", "expressions"],
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base, labels, score, expressions) for every row."""
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id long, n_words long, places array<long>, base array<string>, labels array<string>, score double, expressions array<string>")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", ";").alias("expressions"),
    )

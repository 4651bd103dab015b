"""License scans: Aho-Corasick tags and notice phrases, and a shunting-yard parser for licence expressions.

Each text is read by two automata that are built once per task.  One runs over the text's words
(A-Z lower-cased, other ASCII but letters and digits dropped), joined by one space, and finds notice
phrases at word bounds.  The other runs over the lower-cased text and finds identifier tags
such as ``SPDX-License-Identifier:``; what follows a tag, up to the next one or its line's end, is parsed as an expression
of licence ids with ``AND``, ``OR`` and ``WITH`` and turned to postfix by operator precedence,
then evaluated to its labels and to whether some choice of its alternatives is permissive.

Defined results: a null or empty text has no words and no labels; repeated rows give the same
result; after an SPDX tag an expression that doesn't parse contributes the ids before the error and is not
permissive; after ``license:``, which prose has as well, words count only from an id of a known family on, and
what follows the expression is ignored, for a lower score; a slash between ids reads as ``OR``; texts are read whole, whatever their length; ties do not occur, as labels are sets; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import table

#: Phrases and labels as the contract of the query fixes them.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of well-known licences, in words.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: After these any id counts; after the others, which prose has as well, only ids of known families do.
SURE_TAGS = TAGS[:2]
#: Families of licence ids by the words that they begin with; the longest wins.
FAMILIES = (
    "agpl", "apache", "artistic", "bsd", "bsl", "busl", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0", "epl", "eupl", "gpl", "isc", "lgpl", "mit", "mpl", "unlicense", "zlib",
)
#: Ids that are commonly written for another licence than their family's: the Business Source License, not the Boost one.
ALIASES = {"bsl-1.1": "busl"}
PERMISSIVE = {"apache", "artistic", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "unlicense", "zlib"}
#: How sure each kind of evidence is.
TAG_SCORE, PHRASE_SCORE, NOTICE_SCORE, PROSE_TAG_SCORE = 1.0, 0.9, 0.7, 0.6
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

WORDS_OF_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LINE_END = re.compile(r"[\n\r]")
TOKEN = re.compile(r"[()/]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


@dataclass(frozen=True)
class Verdict:
    labels: frozenset[str]
    permissive: bool


def family(licence_id: str) -> str:
    """The label of a licence id: its family, else the id in lower case."""
    low = licence_id.lower()
    if low in ALIASES:
        return ALIASES[low]
    found = [f for f in FAMILIES if low == f or low.startswith(f + "-") or low.startswith(f) and low[len(f) : len(f) + 1].isdigit()]
    return max(found, key=len, default=low)


def known(licence_id: str) -> bool:
    """Whether an id is of a known family."""
    return family(licence_id) in FAMILIES


def postfix(tokens: Iterable[str]) -> list[str]:
    """Shunting-yard: the longest leading part of ``tokens`` that is an expression, in postfix order."""
    out, ops, wants_id = [], [], True
    for tok in tokens:
        op = tok.lower()
        if op in PRECEDENCE:
            if wants_id:
                break
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[op]:
                out.append(ops.pop())
            ops.append(op)
            wants_id = True
        elif tok == "(":
            if not wants_id:
                break
            ops.append(tok)
        elif tok == ")":
            if wants_id or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if not wants_id:
                break
            out.append(tok)
            wants_id = False
    if wants_id and ops and ops[-1] != "(":
        ops.pop()  # an operator without its second operand
    return out + [x for x in reversed(ops) if x != "("]


def evaluate(expression: str, sure: bool = True) -> Verdict | None:
    """Labels of an expression and whether it can be met by permissive licences alone; None without an id.

    What follows a leading part that is an expression makes it not permissive, as it doesn't parse.  Unless ``sure``, an
    unknown id makes the whole no expression.
    """
    stack: list[Verdict] = []
    tokens = ["or" if x == "/" else x for x in TOKEN.findall(expression)]
    read = postfix(tokens)
    ids = [x for x in read if x not in PRECEDENCE]
    if not sure and not (ids and known(ids[0])):
        return None
    whole = len(read) == sum(x not in "()" for x in tokens) and tokens.count("(") == tokens.count(")")
    for tok in read:
        if tok in PRECEDENCE and len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            if tok == "with":  # an exception only adds permissions
                stack.append(a)
            else:
                ok = a.permissive or b.permissive if tok == "or" else a.permissive and b.permissive
                stack.append(Verdict(a.labels | b.labels, ok))
        elif tok not in PRECEDENCE:
            label = family(tok)
            stack.append(Verdict(frozenset([label]), label in PERMISSIVE))
    if not stack:
        return None
    out = stack[0]
    for x in stack[1:]:
        out = Verdict(out.labels | x.labels, False)
    if not sure:
        out = Verdict(frozenset(x for x in out.labels if known(x)), out.permissive)
    return out if whole or not sure else Verdict(out.labels, False)


def automaton(entries: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, value in entries:
        found.add_word(key, value)
    found.make_automaton()
    return found


def phrase_automaton() -> ahocorasick.Automaton:
    entries = [(f" {p} ", (p, label, True)) for p, label in BASE_PHRASES.items()] + [(f" {p} ", (p, label, False)) for p, label in NOTICE_PHRASES.items()]
    return automaton(entries)


def scan(text: str, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> dict:
    """All evidence in one text: see ``SCHEMA``."""
    words = text.encode("utf-8", "surrogatepass").translate(WORDS_OF_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, score, at, index = [], set(), set(), 0.0, 0, 0
    hits = sorted((end - len(p) - 1, p, label, is_base) for end, (p, label, is_base) in phrases.iter(line))
    for start, _, label, is_base in hits:
        labels.add(label)
        score = max(score, PHRASE_SCORE if is_base else NOTICE_SCORE)
        if is_base:
            base.add(label)
            index += line.count(" ", at, start)
            at = start
            starts.append(index)
    permissive, expressions = None, []
    low = text if text.isascii() else None
    low = text.lower() if low is not None else text.translate(_LOWER)
    # a tag within a longer one begins after it and ends with it
    found_tags = [(end, tag) for end, tag in sorted(tags.iter(low), key=lambda x: (x[0], -len(x[1])))]
    found_tags = [(end, tag) for i, (end, tag) in enumerate(found_tags) if (not i or found_tags[i - 1][0] != end) and not (end >= len(tag) and low[end - len(tag)].isalnum())]
    for i, (end, tag) in enumerate(found_tags):
        next_tag = found_tags[i + 1][0] - len(found_tags[i + 1][1]) + 1 if i + 1 < len(found_tags) else len(text)
        line_end = LINE_END.search(text, end, next_tag)
        stop = line_end.start() if line_end else next_tag
        found = evaluate(text[end + 1 : stop], tag in SURE_TAGS)
        if found:
            labels |= found.labels
            score = max(score, TAG_SCORE if tag in SURE_TAGS else PROSE_TAG_SCORE)
            permissive = found.permissive if permissive is None else permissive and found.permissive
            expressions.append(text[end + 1 : stop].strip())
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": starts[0] if starts else None, "last_word": starts[-1] if starts else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "permissive": permissive, "expressions": expressions,
    }


_LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, expressions array<string>"
FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_()), ("expressions", pa.list_(pa.string()))]


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each document and what ``scan`` finds in its whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = phrase_automaton(), automaton((t, t) for t in TAGS)
        for b in it:
            rows = [scan(t or "", phrases, tags) for t in b.column(len(keep)).to_pylist()]
            cols = [b.column(i) for i in range(len(keep))] + [pa.array([r[k] for r in rows], kind) for k, kind in FIELDS]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(k for k, _ in FIELDS)])

    rows = docs.select(*[f"`{k}`" for k in keep], f"`{text}`")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(batches, f"{kinds}, {SCHEMA}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))

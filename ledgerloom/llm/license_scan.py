"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

A text is reduced to its words (runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased),
joined by single blanks, and one automaton finds every phrase in one pass; a phrase stands between blanks, so it always
matches whole words.  Where an identifier tag is found, the expression after it is read from the original text and
evaluated against the allowed licences: ``and`` needs both sides, ``or`` one of them, ``X with Y`` is the licence X
with an exception and holds if X or the pair ``x with y`` is allowed.

Defined cases: a null or empty text has no words and no labels; a malformed expression is reported, permits nothing
and labels nothing but the licences that it names; repeated rows are scanned one by one; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import byte_texts, keyed_texts

# The phrases and labels that results are held to.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "the unlicense": "unlicense",
    "zlib license": "zlib",
    "do what the fuck you want": "wtfpl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "sil open font license": "ofl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute": "isc",
    "open database license": "odbl",
    "business source license": "busl",
    "server side public license": "sspl",
    "gnu free documentation license": "gfdl",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
# Licences that permit reuse in a training set unless a caller names others.
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "cc-by-3.0", "unlicense", "zlib"})

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG_AT = re.compile(rb"spdx[-\s]license[-\s]identifier\s*:?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | NOTICE_PHRASES | {TAG: ""}).items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


class Malformed(ValueError):
    """An expression that can't be evaluated; ``named`` holds the licences up to its fault."""

    def __init__(self, why: str, named: list[str]):
        super().__init__(why)
        self.named = [x for x in named if x not in _PRECEDENCE]


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression's operands and operators in postfix order; Malformed where it has none.

    The expression ends before the first token that can't continue it, as notices go on after their tag.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in (m[0] for m in _TOKEN.finditer(expression)):
        low = token.lower()
        if operand_next:
            if token == "(":
                stack.append(token)
            elif token == ")" or low in _PRECEDENCE:
                raise Malformed(f"no licence before {token!r}", out)
            else:
                out.append(low)
                operand_next = False
        elif low in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
    if operand_next or "(" in stack:
        raise Malformed("the expression is not complete", out)
    return out + stack[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> bool:
    """Whether the allowed licences satisfy the expression."""
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append((token in allowed, token))
            continue
        (right, right_name), (left, left_name) = stack.pop(), stack.pop()
        name = f"{left_name} {token} {right_name}"
        stack.append(({"and": left and right, "or": left or right, "with": left or name in allowed}[token], name))
    return stack[0][0]


def _family(licence: str) -> str:
    """The label of an identifier: its name without version, as `apache` of `apache-2.0`."""
    return re.split(r"-(?=[\d])", licence)[0].rstrip("+")


def scan_text(text: bytes, allowed: frozenset[str] = ALLOWED) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, expressions, permitted, score) of one text."""
    words = text.translate(_WORDS).split()
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tagged, hits, counted, upto = False, 0, 0, 0
    for end, (n, label, is_base) in _automaton().iter(joined):
        counted += joined.count(" ", upto, end)  # blanks before the match's last one: its last word's place and one
        upto = end
        hits += 1
        if not label:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(counted - n)
    expressions: list[str] = []
    verdicts: list[bool] = []
    if tagged:
        for m in _TAG_AT.finditer(text):
            shown = m[1].decode("utf-8", "replace").strip()
            expressions.append(shown)
            try:
                postfix = to_postfix(shown)
                verdicts.append(evaluate(postfix, allowed))
            except Malformed as e:
                postfix = e.named
                verdicts.append(False)
            exceptions = {postfix[i - 1] for i, t in enumerate(postfix) if t == "with"}
            labels |= {_family(t) for t in postfix if t not in _PRECEDENCE and t not in exceptions}
    permitted = all(verdicts) if verdicts else None
    score = 0.0 if not labels and not verdicts else 1.0 if permitted else 1 - 0.5**hits
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), expressions, permitted, score,
    )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "expressions array<string>, permitted boolean, score double"
)
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """One row for each document: its base and further labels, the places of base phrases, and its expressions.

    score is the strength of the evidence: 0 without any, 1 where every tagged expression holds, else 1 - 2**-hits.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(scan_text(x, allowed) for x in byte_texts(batch)))) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:]))], names)

    return keyed_texts(docs, id_col, text_col).mapInArrow(scan, SCHEMA)

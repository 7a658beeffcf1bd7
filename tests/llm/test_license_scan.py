import re

import pytest

from ledgerloom.llm.license_scan import evaluate, scan_licenses, scan_text, to_postfix

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_columns_match_brute_force(docs, odd):
    for table in (docs, odd):
        wanted = sorted((repr(r["doc_id"]), *map(repr, base(r["text"]))) for r in table.collect())
        cols = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
        assert sorted((repr(r["doc_id"]), *(repr(r[c]) for c in cols)) for r in scan_licenses(table).collect()) == wanted


def test_overlapping_and_adjacent_phrases():
    assert scan_text(b"CC-BY cc by CC by. All rights reserved")[1:5] == (4, 0, 6, "cc-by,reserved")
    assert scan_text(b"GNU Lesser General Public License")[4:6] == ("gpl", "gpl,lgpl")
    assert scan_text(b"occ bys cc bye")[1] == 0


@pytest.mark.parametrize(
    "expression, good",
    [
        ("MIT", True),
        ("GPL-3.0-only", False),
        ("MIT OR GPL-3.0-only", True),
        ("MIT AND GPL-3.0-only", False),
        ("GPL-2.0-only AND MIT OR Apache-2.0", True),
        ("GPL-2.0-only AND (MIT OR Apache-2.0)", False),
        ("(MIT)", True),
        ("MIT and isc", True),
        ("Apache-2.0 WITH LLVM-exception", True),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", True),
        ("MIT -- see the file", True),
    ],
)
def test_expressions(expression, good):
    assert evaluate(to_postfix(expression)) is good


@pytest.mark.parametrize("bad", ["", "AND MIT", "MIT OR", "(MIT", "()", "MIT AND OR ISC"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        to_postfix(bad)


def test_tags_give_labels_and_scores():
    *_, labels, expressions, permitted, score = scan_text(b"# SPDX-License-Identifier: Apache-2.0 OR GPL-3.0\ncode")[4:]
    assert (labels, expressions, permitted, score) == ("apache,gpl", ["Apache-2.0 OR GPL-3.0"], True, 1.0)
    assert scan_text(b"SPDX-License-Identifier: (MIT")[7] is False
    assert scan_text(b"SPDX-License-Identifier: GPL-3.0 AND (")[5:8] == ("gpl", ["GPL-3.0 AND ("], False)
    assert scan_text(b"SPDX-License-Identifier: MIT OR OR x")[5] == "mit"
    assert scan_text(b"nothing here")[5:] == ("", [], None, 0.0)


def test_empty_table(none):
    assert scan_licenses(none).count() == 0

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing


def whole_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(table, window=packing.WINDOW):
    rows = packing.pack(table, window=window).collect()
    texts = defaultdict(list)
    for r in table.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(whole_ids(r["text"]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, ids in texts.items():
        wanted = sorted((a, min(window, len(x) - a), zlib.crc32(x[a : a + window].tobytes()), len(x)) for x in ids for a in range(0, len(x), window))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc]) == wanted
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert sum(r["length"] for r in own) <= window
    return rows, sequences


def test_every_id_lies_in_one_piece(docs, odd):
    _, sequences = check(docs)
    padded = sum(packing.WINDOW for _ in sequences)
    assert sum(r["length"] for own in sequences.values() for r in own) > 0.97 * padded
    check(odd)
    check(odd, window=16)


def test_empty_table(none):
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_matches_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    used = []
    for n in lengths:
        fits = [i for i, u in enumerate(used) if u + n <= 64]
        if fits:
            used[max(fits, key=lambda i: used[i])] += n
        else:
            used.append(n)
    sequence, offset = packing.best_fit(lengths, 64)
    own = np.bincount(sequence, lengths, minlength=len(used)).astype(int) if lengths else []
    assert sorted(own) == sorted(used)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAbZ.,'s \ń̌<|>ſKİ漢0 9", max_size=30), max_size=6))
def test_runs_give_the_ids_of_the_whole_text(texts):
    if not hasattr(packing, "_test_tokenizer"):
        packing._test_tokenizer = packing.RunTokenizer()
    got = list(packing._test_tokenizer.ids([t.encode() for t in texts]))
    assert [list(np.frombuffer(x, "<u4")) for x in got] == [list(whole_ids(t)[:-1]) for t in texts]

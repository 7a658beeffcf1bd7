import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import mixing


def level_targets(sizes):
    """By resharing what is above the caps, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if goal[s] > 3 * sizes[s]}
        if not above:
            return goal
        capped |= above


def check(table):
    rows = mixing.mix(table).collect()
    size = Counter()
    for r in table.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    goal = level_targets(size)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert Counter(repr(r["doc_id"]) for r in rows) == Counter(repr(r["doc_id"]) for r in table.collect())
    return rows


def test_targets_are_met(docs, odd, none):
    rows = check(docs)
    check(odd)
    assert sorted(map(repr, mixing.mix(docs.repartition(7)).collect())) == sorted(map(repr, rows))
    assert mixing.mix(none).count() == 0


def test_small_sources_are_capped(spark):
    rows = [(i, "w " * 10, f"s{i % 5}") for i in range(50)] + [(100, "only three words", "zz"), (101, "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["source"]: r["target"] for r in check(table)}
    assert found["zz"] == 9.0 and found[None] == 3.0


def test_whole_epochs_come_before_a_part(docs):
    by_source = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by_source[r["source"]].append(r)
    for own in by_source.values():
        epochs = int(own[0]["target"] // own[0]["source_size"])
        assert all(epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"] for r in own)
        assert sum(0 < r["taken"] - epochs * r["size"] < r["size"] for r in own) <= 1


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, ("good " * 20) if i % 2 else ("b#d$ " * 20), "a" if i < 4000 else "b") for i in range(4400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    part = [r for r in mixing.mix(table).collect() if r["source"] == "a"]
    taken = lambda odd: sum(r["taken"] for r in part if r["doc_id"] % 2 == odd)
    assert taken(0) + taken(1) == 64_000 and taken(1) > 0.95 * 40_000


def test_sample_holds_what_is_taken(docs, odd, none):
    for table in (docs, odd):
        out = mixing.sample(table)
        assert out.columns == table.columns
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        got = Counter()
        for r in out.collect():
            got[repr(r["doc_id"])] += words(r["text"])
        want = Counter()
        for r in mixing.mix(table).collect():
            want[repr(r["doc_id"])] += r["taken"]
        if table is docs:
            assert +got == +want
        assert abs(sum(got.values()) - sum(want.values())) <= 8
    assert mixing.sample(none).count() == 0


def test_sample_with_clashing_columns(spark, docs):
    few = docs.filter("doc_id < 40")
    names = ["mix_doc_id", "mix_mark", "mix_taken", "mix_size", "mix_rows", "mix_copy", "MIX_ROWS_"]
    clashing = few.selectExpr("*", *(f"'x' as {c}" for c in names))
    out = mixing.sample(clashing)
    assert out.columns == clashing.columns
    assert sorted(map(repr, out.select(few.columns).collect())) == sorted(map(repr, mixing.sample(few).collect()))

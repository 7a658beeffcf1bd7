import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(level):
    """The root and every leaf's siblings (left, right) by level, by brute force."""
    steps = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            steps[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        level, at = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [p // 16 for p in at]
    return level[0], steps


def wanted(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r[0] is not None, r[0] or 0), leaf_of(r), r) for r in trees[s]) for s in order}
    sub = {s: climbed([x[1] for x in own[s]]) for s in order}
    root, upper = climbed([sub[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, leaf, r), steps in zip(own[s], sub[s][1]):
            whole = steps + upper[k]
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = text.translate(str.maketrans(manifest.UPPER, manifest.LOWER))
            now = leaf_of((*r[:4], text))
            for left, right in whole:
                now = h(left + now + right)
            out.append((r[0], leaf, sub[s][0], root, h("".join(a + b for a, b in whole)), now, now == root))
    return sorted(out, key=repr)


def given(df):
    return sorted((tuple(r) for r in manifest.audit(df).collect()), key=repr)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.randrange(99), rng.choice(["Abc Ä", "abc", "", None, "X" * 50]) ) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (1, [None]), (16, ["a"]), (17, ["a"]), (40, ["a", "b", "ä", None]), (300, ["a"] * 30 + [f"s{i}" for i in range(40)]), (4200, ["hot"] * 50 + ["b"])])
def test_against_brute_force(spark, n, sources):
    rows = rows_of(n, sources)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert given(df) == wanted(rows)


def test_odd_rows(odd):
    rows = [tuple(r[c] for c in FIELDS) for r in odd.collect()]
    assert given(odd) == wanted(rows)


def test_nothing(none):
    assert manifest.audit(none).collect() == []


def test_partial_parents_are_finished_by_others(spark, monkeypatch):
    """Leaves in random order, few partial parents held at a time: all is settled in the rounds."""
    monkeypatch.setattr(manifest, "HELD", 3)
    n = 5000
    leaves = [h(str(i)) for i in range(n)]
    df = spark.createDataFrame([(b"t", n, i, x) for i, x in enumerate(leaves)], "tree binary, n long, pos long, leaf string").orderBy(F.rand(3))
    nodes = manifest.grown(df).collect()
    assert len(nodes) == len({(r["level"], r["node"]) for r in nodes}) == 313 + 20 + 2 + 1
    assert manifest.tops(manifest.grown(df)).collect()[0]["top"] == climbed(leaves)[0]


def test_frontier_emits_ancestors_when_complete():
    f = manifest.Frontier()
    out = [row for i in range(16) for row in f.take(b"", 17, 1, 0, [None] * i + [str(i)])]
    assert [(r[2], r[3]) for r in out] == [(1, 0)] and len(f.open) == 1
    out = list(f.take(b"", 17, 1, 1, ["16"]))
    assert [(r[2], r[3]) for r in out] == [(1, 1), (2, 0)] and not f.open


def test_proofs_tell_changed_rows(spark, docs):
    changed = F.when(F.col("doc_id") == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    assert [r["doc_id"] for r in manifest.manifest(docs, changed).filter("not verified").collect()] == [7]

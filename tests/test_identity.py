"""Likeness of names against a plain brute force and known values, and the candidates that follow from it."""

import random

import numpy as np
import pytest

from ledgerloom import queries as engine
from ledgerloom.operators import identity, likeness


def subsequence(a, b):
    best = [0] * (len(b) + 1)
    for c in a:
        before = best[:]
        for k, d in enumerate(b, 1):
            best[k] = before[k - 1] + 1 if c == d else max(before[k], best[k - 1])
    return best[-1]


def brute(a, b):
    """2 * common / total of the three strings that the sorted words make."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(w for w in [both, " ".join(sorted(own))] if w) for own in (x - y, y - x))
    ratio = lambda p, q: 2 * subsequence(p, q) / (len(p) + len(q))
    return max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])


def names(rng, n):
    words = ["acme", "acne", "traders", "trader", "steel", "and", "co", "x", "gupta", "guptas", "öl", "mühle", "a" * 70, "b" * 66 + "c"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(n)] + ["", " ", " ".join(f"w{i}" for i in range(70))]


# Known scores of the published token set ratio.
KNOWN = [
    ("fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0), ("new york mets", "new york mets vs atlanta braves", 1.0), ("", "", 0.0), ("a", "", 0.0),
    ("abc", "abd", 2 / 3), ("acme traders", "acme tradars", 22 / 24), ("acme steel", "acme", 1.0), ("steel acme", "acme steel", 1.0), ("alpha", "zzz", 0.0),
]


@pytest.mark.parametrize("a, b, score", KNOWN)
def test_known_scores(a, b, score):
    assert abs(likeness.of_pair(a, b) - score) < 1e-12 and abs(identity._scores([a], [b])[0] - round(score, 4)) < 1e-12


def test_many_pairs_at_once():
    rng = random.Random(1)
    x, y = names(rng, 60), names(rng, 70)
    numbers, alphabet = {}, {}
    a, b = likeness.Names(x, numbers, alphabet), likeness.Names(y, numbers, alphabet)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij"))
    want = np.array([brute(x[p], y[q]) for p, q in zip(i, j)])
    assert np.allclose(likeness.of_pairs(a, b, i, j), want)
    for least in (0.5, 0.7, 0.9):
        got = likeness.of_pairs(a, b, i, j, least)
        assert np.allclose(got[want >= least], want[want >= least]) and (got <= want + 1e-12).all()


def candidates(left, right, limit, keep, itself, rejected=()):
    out = {}
    for i, a in left:
        share = [k for k, b in right if {w for w in a.split() if len(w) > 1} & {w for w in b.split() if len(w) > 1} and (itself or k != i)]
        share = [k for k in (sorted(share) if limit is None else sorted(share)[:limit]) if (i, k) not in rejected]
        scored = sorted(((round(brute(a, dict(right)[k]), 4), k) for k in share), key=lambda t: (-t[0], t[1]))
        if scored:
            best, gap = scored[0][0], round(scored[0][0] - (scored[1][0] if len(scored) > 1 else 0), 4)
            status = "HIGH_CONFIDENCE" if best >= 0.9 and gap >= 0.08 else "REVIEW_REQUIRED" if best >= 0.7 else "UNMAPPED"
            out[i] = [(k, s, status) for s, k in scored if limit is not None or s >= 0.7][:keep]
    return {i: c for i, c in out.items() if c}


def given(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["left_id"], r["rank"])):
        out.setdefault(r["left_id"], []).append((r["right_id"], r["score"], r["status"]))
    return out


@pytest.mark.parametrize("limit", [None, 7])
@pytest.mark.parametrize("itself", [True, False])
def test_candidates(spark, monkeypatch, limit, itself):
    monkeypatch.setattr(identity, "TILE", 5)
    rng = random.Random(2)
    left, right = list(enumerate(names(rng, 50))), list(enumerate(names(rng, 60)))
    left = right if not itself else left
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    assert given(identity.fuzzy_candidates(frame(left), frame(right), limit=limit, itself=itself)) == candidates(left, right, limit, 5, itself)
    turned = [(i, k) for i in range(len(left)) for k in (1, 2, 5, 8)]
    rejected = spark.createDataFrame(turned, "left_id long, right_id long")
    assert given(identity.fuzzy_candidates(frame(left), frame(right), limit=limit, itself=itself, rejected=rejected)) == candidates(left, right, limit, 5, itself, set(turned))


def test_an_exact_name_is_never_lost(spark):
    right = [(i, f"acme number{i}") for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    (first,) = [r for r in identity.fuzzy_candidates(frame([(1, "number390 acme")]), frame(right), limit=None).collect() if r["rank"] == 1]
    assert (first["right_id"], first["score"]) == (390, 1.0)
    # no shared word, no candidate: one deductor and a thousand customers
    assert identity.fuzzy_candidates(frame([(1, "lonely")]), frame([(i, f"other{i}") for i in range(1000)]), limit=None).count() == 0


def test_who_a_deductor_is(spark):
    """Every tier and every status, and which of several codes counts."""
    masters = [
        ("C1", "Acme Steel Limited", 1, ["T1", "T9"], ["Steel House"]), ("C2", "Beta Traders", 2, ["T9"], ["Acme Steel", "Steel House", "Shared"]), ("C3", "Gamma Foods", 3, [], ["Shared"]),
        ("C4", "Delta Chemical Works", 4, [], []), ("C5", "Delta Chemical Work", 5, [], []), ("C6", "Twin", 6, [], []), ("C7", "Twin", 7, [], []), ("C8", "Omega Transport Lines", 8, [], []),
    ]
    m = spark.createDataFrame(masters, "code string, name string, position long, tans array<string>, aliases array<string>")
    deductors = [
        ("T1", "anything"), ("T9", "x"), ("T2", "mapped"), ("T3", "gone"), ("T4", "ACME STEEL LTD"), ("T5", "Steel House"), ("T6", "Shared"), ("T7", "twin"), ("T8", "known as"), ("TA", "second alias"),
        ("TB", "Omega Transport Line"), ("TC", "Delta Chemical"), ("TD", "Nothing Alike"), ("TE", "Omega Transport Line"), ("TF", "Omega Transport Line"), ("TG", "Zebra Foods Transport"),
    ]
    d = spark.createDataFrame(deductors, "tan string, name string")
    mappings = spark.createDataFrame([("T2", "C3"), ("T3", "C99"), ("T1", "C8")], "tan string, code string")
    aliases = spark.createDataFrame([("Known As", "C4", 1), ("Known As", "C5", 2), ("Second Alias", "C98", 1), ("Gamma Foods", "C1", 1)], "alias string, code string, position long")
    decisions = spark.createDataFrame([("TE", "KEEP_UNMAPPED", []), ("TF", None, ["C8"])], "tan string, action string, rejected array<string>")
    for limit in (250, None):
        got = {r["tan"]: (r["code"], r["status"], r["method"], r["suggested_code"]) for r in identity.resolve(d, m, mappings, aliases, decisions, limit).collect()}
        assert got == {
            "T1": ("C1", "EXACT", "CUSTOMER_MASTER", "C1"), "T9": ("C2", "EXACT", "CUSTOMER_MASTER", "C2"), "T2": ("C3", "EXACT", "SAVED_MAPPING", "C3"), "T3": (None, "UNMAPPED", "NONE", None),
            "T4": ("C1", "EXACT", "EXACT_NAME", "C1"), "T5": ("C1", "EXACT", "MASTER_ALIAS", "C1"), "T6": ("C2", "EXACT", "MASTER_ALIAS", "C2"), "T7": ("C7", "EXACT", "EXACT_NAME", "C7"),
            "T8": ("C4", "EXACT", "SAVED_ALIAS", "C4"), "TA": (None, "UNMAPPED", "NONE", None), "TB": ("C8", "HIGH_CONFIDENCE", "FUZZY", "C8"), "TC": (None, "REVIEW_REQUIRED", "FUZZY", "C4"),
            "TD": (None, "UNMAPPED", "NONE", None), "TE": (None, "UNMAPPED", "NONE", None), "TF": (None, "UNMAPPED", "NONE", None), "TG": (None, "UNMAPPED", "NONE", None),
        }


def test_deductors_of_one_name_are_weighed_once(spark, monkeypatch):
    """Copies of a table's names: no task gets pairs of rows, and the candidates are those of plain loops."""
    monkeypatch.setattr(identity, "TILE", 5)
    some = names(random.Random(6), 12)
    both = [(100 * c + k, name) for c in range(5) for k, name in enumerate(some)]
    frame = spark.createDataFrame(both, "id long, name string")
    for limit in (None, 7, 30):
        found = identity.fuzzy_candidates(frame, frame, limit=limit, itself=False)
        assert given(found) == candidates(both, both, limit, 5, False)
        assert "windowspecdefinition(left_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_two_customers_of_the_best_name_leave_no_gap(spark):
    """Also where only the first candidate is asked for: the second decides its status."""
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    for right in ([(1, "omega transport lines"), (2, "omega transport lines")], [(1, "omega transport lines"), (2, "omega transport line")]):
        for limit in (None, 250):
            (first,) = identity.fuzzy_candidates(frame([(9, "omega transport lines")]), frame(right), limit=limit, keep=1).collect()
            assert (first["right_id"], first["status"]) == (1, "REVIEW_REQUIRED")


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_no_candidate_is_lost_by_default(spark, monkeypatch, few):
    """The best of all that share a word, whatever their scores: in tiles of many pairs, and in tiles put together."""
    monkeypatch.setattr(identity, "TILE", 30)
    monkeypatch.setattr(identity, "FEW", few)
    rng = random.Random(7)
    left, right = list(enumerate(names(rng, 80))), list(enumerate(names(rng, 300)))
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    assert given(identity.fuzzy_candidates(frame(left), frame(right), least=0.0)) == candidates(left, right, 10**6, 5, True)
    assert given(identity.fuzzy_candidates(frame(left), frame(right))) == candidates(left, right, None, 5, True)


def test_bounds_hold_and_are_of_use():
    rng = random.Random(8)
    x, y = names(rng, 60), names(rng, 70)
    numbers, alphabet = {}, {}
    a, b = likeness.Names(x, numbers, alphabet), likeness.Names(y, numbers, alphabet)
    got = likeness.bounds(a, b, np.arange(len(x)), np.arange(len(y)))
    want = np.array([[brute(p, q) for q in y] for p in x])
    assert (got >= want - 1e-6).all() and (got < 0.7).mean() > 0.3


def test_parts_find_the_most_alike_of_all_parts(spark, tmp_path):
    """The part of the other's name has the last key of 400 that share a word."""
    rows = [(0, "red bolts gear")] + [(k, f"gear {k}x{k}") for k in range(1, 400)] + [(400, "red bolt gear")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = engine.QUERIES["fuzzy_topk"](spark, str(tmp_path)).filter("left_id = 0").orderBy("rank").collect()
    assert len(found) == 5 and found[0]["right_id"] == 400 and found[0]["status"] == "HIGH_CONFIDENCE"

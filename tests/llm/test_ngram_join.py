import random

import numpy as np

from ledgerloom.llm import ngram_join as nj


def sets(rows):
    out = []
    for id_, text in rows:
        w = (text or "").encode().lower().split()
        out.append((id_, frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5))))))
    return out


def brute(rows):
    own = sets(rows)
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(own):
        for j in range(i):
            b = own[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, (id_, _) in enumerate(own):
        if id_ is not None:
            low[find(i)] = min(low.get(find(i), id_), id_)
    return sorted((repr(id_), len(s), repr(low.get(find(i)) if s else id_)) for i, (id_, s) in enumerate(own))


def got(table):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in nj.classes(table).collect())


def test_matches_brute_force(docs, odd, texts):
    assert got(docs) == brute(list(texts.items()))
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def near_copies(seed, n, size):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, max(1, size // 12))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            words = words[: rng.randrange(size * 3 // 5, size)]
        rows.append((i, " ".join(words)))
    return rows


def test_large_groups_of_near_copies(spark):
    passage = " ".join(f"common{i}" for i in range(60))
    rng = random.Random(5)
    rows = near_copies(1, 90, 120)
    rows += [(1000 + i, t) for i, t in near_copies(2, 40, 30)]
    rows += [(2000 + i, t) for i, t in near_copies(3, 12, 300)]
    rows += [(3000 + i, passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(200))) for i in range(60)]
    rows += [(4000 + i, " ".join(f"c{k}" for k in range(i, i + 40))) for i in range(0, 80, 2)]  # a chain
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, n // 10 + 1).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert sum(int(x).bit_count() for x in (nj.sketch(a) ^ nj.sketch(b)).view(np.uint64)) <= apart
        ka, kb = set(nj.blocks(a, 512).tolist()), set(nj.blocks(b, 512).tolist())
        assert len(ka - kb) <= apart and len(kb - ka) <= apart
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            given = [set(nj.block_keys(x, np.zeros(0, np.uint64)).tolist()) for x in (a, b)]
            assert len(given[0] & given[1]) >= min(nj.least_shared(len(a)), nj.least_shared(len(b)))


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in nj.components(links).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == found[103] == 100


def test_first_of_each(odd, none):
    kept = nj.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(repr(r["doc_id"]) for r in kept.collect())
    assert "2" not in ids and ids.count("10") == 2 and "None" in ids and "3" in ids
    assert nj.classes(none).count() == nj.first_of_each(none).count() == 0


def test_word_hashes_do_not_depend_on_what_stands_around():
    from ledgerloom.llm.runtime import word_hashes

    h, place, last = word_hashes(b"foo bar " + b"z" * (1 << 18) + b"\tFOO  bar\n")
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert place.tolist()[:3] == [0, 4, 8]
    assert (last - place).tolist() == [3, 3, 1 << 18, 3, 3]
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n ")[0]) == 0


def test_isolated_pairs_of_unequal_sizes(spark):
    # the larger set's own share of blocks is more than the smaller one gives out: each pair is alone
    rows, linked = [], 0
    for large, small in ((8, 6), (16, 12), (4, 3), (5, 4), (21, 16), (24, 18), (20, 15), (2, 2), (32, 24), (64, 48), (40, 31), (9, 8), (340, 255), (256, 200)):
        for seed in range(12 if large > 100 else 40):
            words = [f"w{large}x{small}x{seed}x{k}" for k in range(large + 4)]
            at = seed % (large - small + 1)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[at : at + small + 4]))]
            linked += 1
    found = nj.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [r["doc_id"] for r in found if r["component_id"] != r["doc_id"] // 2 * 2] == []
    assert sum(r["n_links"] == 1 for r in found) == 2 * (linked - 40)  # (2, 2) is one text twice


def test_keys_given_out_suffice_for_what_is_asked():
    rng = np.random.default_rng(1)
    for percent in (50, 60, 75, 90):
        for n in (1, 2, 3, 4, 6, 8, 12, 15, 16, 20, 21, 22, 31, 64, 100, 255, 256, 300):
            large = n * 100 // percent
            for _ in range(20):
                b = np.unique(rng.integers(0, 2**63, large).astype(np.uint64))
                a = np.sort(rng.permutation(b)[:n])
                given = [set(nj.block_keys(x, np.zeros(0, np.uint64), percent).tolist()) for x in (a, b)]
                assert len(given[0] & given[1]) >= max(nj.least_met(n, percent), nj.least_met(large, percent)), (percent, n, large)


def test_links_are_counted_in_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 16)
    rows = near_copies(7, 60, 100) + [(100 + i, " ".join(f"c{k}" for k in range(i, i + 40))) for i in range(24)] + [(200, None), (201, "alone here")]
    rows += [(300 + i, t) for i, t in near_copies(8, 5, 50)] + [(400, rows[0][1])]
    own = [s for _, s in sets(rows)]
    want = [sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in set(own) if b) if a else 0 for a in own]
    found = {r["doc_id"]: r["n_links"] for r in nj.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[id_] for id_, _ in rows] == want


def test_first_of_each_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m"), (3, "h i j k l m"), (3, "n o p q r s")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as gone", "'y' as again", "1 as GONE_")
    out = nj.first_of_each(table)
    assert out.columns == table.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, rows[0][1]), (3, rows[2][1]), (3, rows[4][1])]


def test_shared_elements(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(nj, "MEETINGS", 50)
    for most in (1, 5, 60, 400):
        x, y = ([np.sort(rng.choice(most, rng.integers(1, most + 1), False)).astype(np.uint64) for _ in range(k)] for k in (9, 40))
        got = nj.shared_elements(np.concatenate(x), np.concatenate(y), np.array([len(s) for s in x]), np.array([len(s) for s in y]))
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]

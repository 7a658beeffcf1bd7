import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ledgerloom.llm import lm


def brute(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, own in tokens for w in own if not out_of(i))
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (repr(i), out_of(i), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 4)) for i, own in tokens
    )


def got(table):
    rows = lm.score(table).collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)


def test_base_matches_brute_force(docs, odd, texts):
    for have, want in ((got(docs), brute(texts.items())), (got(odd), brute([(r["doc_id"], r["text"]) for r in odd.collect()]))):
        assert [r[:5] for r in have] == [r[:5] for r in want]
        assert all(abs(a[5] - b[5]) < 2e-3 for a, b in zip(have, want))


def test_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = lm.score(docs).filter("held_out").select("n_tokens", "base_score", "score").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] - r["base_score"] for r in rows) / tokens > 0.05


def one_by_one(model, words):
    """log10 P of every token of a text, by loops: the softmaxes of the hashed features, then the share of the word."""
    mix = lambda x: int(lm.mix64(np.array([x % (1 << 64)], np.uint64))[0])
    salts = [int(x) for x in lm._SALTS]
    kept = dict(zip(model.keys.tolist(), zip(model.counts.tolist(), model.heads.tolist())))
    one, two, out = int(lm.START), int(lm.START), []
    for w in words:
        cls = 0 if w == 0 else 1 + ((w & 0xFFFF) * 40503 >> 4) % (model.classes - 1)
        raw = [mix(one ^ salts[0]), mix((one * 3 + two) % (1 << 64) ^ salts[1]), mix(two ^ salts[2])]
        p = np.exp(sum(model.weights[0][x % model.buckets] for x in raw) + model.prior)
        q = np.exp(sum(model.weights[1][mix(x + cls * salts[3]) % model.buckets] for x in raw) + model.prior_head[cls])
        count, head = kept.get(w, (0, model.other))
        head = 0 if w == 0 else head
        log = math.log10(p[cls] / p.sum()) + math.log10(q[head] / q.sum())
        out.append(log + (math.log10(count + 0.5) - model.among[cls] if cls and head == model.other else 0))
        one, two = w, one
    return out


def test_scores_match_brute_force(docs, spark):
    few = spark.createDataFrame(docs.limit(60).collect(), docs.schema)
    model, counts, _ = lm.fit(few)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in few.collect()}
    found = {r["doc_id"]: r["score"] for r in lm.score(few).collect()}
    for id_, text in list(texts.items())[:25]:
        own, lengths = lm.tokens([text])
        assert abs(sum(one_by_one(model, own.tolist())) - found[id_]) < 1e-3 * lengths[0] + 1e-3, id_


def test_probabilities_add_up(docs):
    model, counts, total = lm.fit(docs)
    table = counts.toPandas()
    own = table["h"].to_numpy().view(np.uint64)
    known, count, cls, head = model.find(own)
    assert count[known].tolist() == table["n"][known].tolist()
    frequency = table["n"].to_numpy()
    # within each class, what its words and the unseen one have of the further head's share is all of it
    others = (head == model.other) & (cls > 0)
    for c in np.unique(cls[others]):
        share = 10 ** (np.log10(frequency[others & (cls == c)] + 0.5) - model.among[c])
        assert share.sum() + 0.5 * 10 ** -model.among[c] == pytest.approx(1)
    heads = [(c, h) for c, h in zip(cls[~others], head[~others])]
    assert len(set(heads)) == len(heads) and total["n"] == frequency.sum()
    text, lengths = lm.tokens([b"the of and", b""])
    _, _, cls, _ = model.find(text)
    for level, f in enumerate(model.features(text, lengths, cls)):
        assert np.allclose(model.probabilities(level, f, cls).sum(1), 1, atol=1e-5)
    assert np.abs(model.weights[0]).max() > 0 and np.abs(model.weights[1]).max() > 0


def test_gradient_matches_brute_force(docs, spark):
    few = spark.createDataFrame(docs.limit(12).collect(), docs.schema)
    model, *_ = lm.fit(few, rounds=1)
    texts = [(r["text"] or "").encode()[:2000] for r in few.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    shared = type("Shared", (), {"value": model})
    got = {r["block"]: np.frombuffer(r["sums"], np.float32).reshape(2, -1, model.classes) for out in lm._gradient(shared)(iter([batch])) for r in out.to_pylist()}
    want = np.zeros((2, 2, model.buckets, model.classes))
    for text in texts:
        own, lengths = lm.tokens([text])
        _, _, cls, head = model.find(own)
        for level, (f, outcome) in enumerate(zip(model.features(own, lengths, cls), (cls, head))):
            p = model.probabilities(level, f, cls)
            for bucket in f:
                np.add.at(want[level, 0], (bucket, outcome), 1)
                np.add.at(want[level, 1], bucket, p)
    for level in (0, 1):
        for block in range(model.buckets // lm.BLOCK):
            part = want[level, :, block * lm.BLOCK : (block + 1) * lm.BLOCK]
            own = got.get(level << 32 | block)
            assert np.allclose(own, part, atol=1e-3) if own is not None else not part[0].any()


def test_empty_tables(none, odd):
    assert lm.score(none).count() == 0
    assert lm.score(odd.filter("doc_id = 6")).count() == 1
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][0]
    rows = lm.score(odd.sparkSession.createDataFrame([(held, "only held out text")], "doc_id long, text string")).collect()
    assert rows[0]["train_tokens"] == 0 and rows[0]["base_score"] == pytest.approx(0.0)


def test_the_model_does_not_depend_on_how_texts_are_dealt_out(spark, docs):
    long = "long" * 40
    rows = [(i, f"often w{i % 7} word {long} once{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    models = [lm.fit(table.repartition(n, "doc_id"))[0] for n in (1, 40)]
    for name in ("keys", "counts", "heads", "prior", "prior_head", "among"):
        assert np.array_equal(*(getattr(m, name) for m in models))
    scores = [{r["doc_id"]: r["score"] for r in lm.score(docs.repartition(n)).collect()} for n in (1, 16)]
    assert all(abs(scores[0][k] - v) < 1e-3 * max(1, abs(v)) for k, v in scores[1].items())


def test_the_model_grows_with_its_tokens():
    shapes = [lm.shape(n) for n in (0, 10, 10**3, 10**6, 10**9, 10**12)]
    assert shapes == sorted(shapes) and len(set(shapes)) >= 5
    assert all(c * b <= lm.MOST_WEIGHTS and b % lm.BLOCK == 0 for c, b in shapes)


def test_only_the_base_counts_of_words_that_do_not_travel(docs, odd):
    for table in (docs, odd):
        rows = [{repr(r["doc_id"]): (r["n_known"], round(r["base_score"], 4)) for r in lm.score(table, top=n).collect()} for n in (50, 10**6)]
        assert rows[0].keys() == rows[1].keys() and all(rows[0][k][0] == v[0] and abs(rows[0][k][1] - v[1]) < 2e-3 for k, v in rows[1].items())


def test_probabilities_are_made_few_at_once():
    rng = np.random.default_rng(1)
    classes, buckets, n = 64, 128, 3 * lm.MADE // 64 + 5
    model = lm.Model(pd.DataFrame({"h": rng.integers(2, 1 << 62, 500), "n": 3, "head": -1}), pd.DataFrame({"cls": [1], "n": [9], "v": [3]}), classes, buckets)
    model.weights = [rng.normal(size=w.shape).astype(np.float32) for w in model.weights]
    features, cls, outcome = rng.integers(0, buckets, (3, n)), rng.integers(1, classes, n), rng.integers(0, classes, n)
    sizes = [x.size for _, x, _ in model.exponentials(0, features, cls)]
    assert sum(sizes) == n * classes and max(sizes) <= lm.MADE
    w = model.weights[0].astype(np.float64)
    want = np.exp(w[features].sum(0) + model.prior)
    want /= want.sum(1, keepdims=True)
    assert np.allclose(model.probabilities(0, features, cls), want, atol=1e-6)
    assert np.allclose(model.log_probability(0, features, cls, outcome), np.log10(want[np.arange(n), outcome]), atol=1e-4)


def test_rows_of_frequent_places_add_up():
    rng = np.random.default_rng(2)
    for places, n in ((1, 5000), (7, 1), (300, 5000), (1 << 17, 5000), (40, 0)):
        at, rows = np.minimum(rng.zipf(1.2, n), places) - 1, rng.random((n, 16)).astype(np.float32)
        want, got = np.ones((places, 16)), np.ones((places, 16), np.float32)
        np.add.at(want, at, rows)
        lm._add_rows(got, at, rows)
        assert np.allclose(got, want, rtol=1e-5)

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_columns_match_brute_force(docs, odd):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for table in (docs, odd):
        wanted = sorted((repr(r["doc_id"]), *base(r["text"])) for r in table.collect())
        assert sorted((repr(r["doc_id"]), *(r[c] for c in cols)) for r in quality.judge(table).collect()) == wanted


def test_repeated_windows():
    assert quality.base_counts(b"a b c d e a b c d e")[4] == 10
    assert quality.base_counts(b"a b c d e f a b c d e")[4] == 10
    assert quality.base_counts(b"a a a a a a")[4] == 6
    assert quality.base_counts(b"a a a a a")[4] == 0
    assert quality.base_counts(b"x\n\nx\n \n \nx y\nx")[3] == 2


def spelt(text):
    """The text's characters as the model takes them, three edges before and one after."""
    points = (re.sub(r"[0-9]", "0", re.sub(r"[ \t\n\v\f\r]", " ", c)) for c in re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ["E"] * 3 + [c if 0 < ord(c) < 1 << 16 else chr(1) if c == "\0" else chr(0xD800 + (ord(c) & 0x7FF)) for c in points] + ["E"]


def kneser_ney(texts):
    """log10-free brute force: P(character | history) by dictionaries of tuples."""
    counts = {4: Counter(tuple(t[i : i + 4]) for t in map(spelt, texts) for i in range(len(t) - 3))}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    level = {}
    for order, own in counts.items():
        n1, n2, n3, n4 = (max(1, sum(n == k for n in own.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), k - 0.05) for x, k in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3))]
        total, mass = Counter(), Counter()
        for g, n in own.items():
            total[g[:-1]] += n
            mass[g[:-1]] += d[min(n, 3) - 1]
        level[order] = own, total, mass, d

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        own, total, mass, d = level[len(gram)]
        context, n = gram[:-1], own[gram]
        if not total[context]:
            return p(gram[1:])
        return (n - d[min(n, 3) - 1] if n else 0) / total[context] + mass[context] / total[context] * p(gram[1:])

    return p, counts


def test_log_perplexities_match_brute_force(docs, odd, monkeypatch):
    monkeypatch.setattr(quality, "SLOT_BITS", 60)  # no two n-grams in one slot
    for table in (docs.limit(40), odd.filter("doc_id != 6 or doc_id is null")):
        rows = table.collect()
        p, counts = kneser_ney([r["text"] for r in rows])
        table = table.sparkSession.createDataFrame(rows, table.schema)
        assert sum(r["n"] for r in quality.gram_counts(table).collect()) == sum(counts[4].values())
        got = sorted((repr(r["doc_id"]), round(r["log_perplexity"], 4)) for r in quality.judge(table).collect())
        want = []
        for r in rows:
            s = spelt(r["text"])
            logs = [math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]
            want.append((repr(r["doc_id"]), -sum(logs) / len(logs)))
        want.sort()
        assert [x[0] for x in got] == [x[0] for x in want]
        assert [(x, y) for x, y in zip(got, want) if abs(x[1] - y[1]) >= 2e-4] == []


def test_model_is_a_distribution(docs):
    counts = quality.gram_counts(docs)
    for bits in (quality.SLOT_BITS, 9):
        model = quality.KneserNey.fit(counts, bits)
        assert all((np.diff(keys.astype(object)) > 0).all() and len(keys) <= 1 << bits for keys, _ in model.grams.values())
        symbols = model.grams[1][0]
        if bits == 9:
            assert len(model.grams[4][0]) > 400
        for gram in [*np.random.default_rng(1).choice(model.grams[4][0], 20), np.uint64(0x1234123412341234)]:
            p = model.probability((gram >> np.uint64(16) << np.uint64(16)) + symbols)
            assert (p > 0).all() and abs(p.sum() + model.uniform * np.prod([max(0, float(model._probe(model.contexts[k], np.array([(int(gram) & ((1 << 16 * k) - 1)) >> 16], np.uint64), 1.0)[0])) for k in (1, 2, 3, 4)]) - 1) < 1e-3


def test_model_does_not_depend_on_how_texts_are_dealt_out(docs, monkeypatch):
    found = [sorted((r["doc_id"], r["kept"], round(r["log_perplexity"], 9)) for r in quality.judge(docs.repartition(n)).collect()) for n in (1, 16)]
    assert found[0] == found[1]
    monkeypatch.setattr(quality, "HELD", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([(r["text"] or "").encode() for r in docs.collect()])], ["text"])
    total = Counter()
    for out in quality._count(iter([batch, batch])):
        total.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())))
    assert total == {r["gram"]: 2 * r["n"] for r in quality.gram_counts(docs).collect()}


def test_bands_match_quartiles(docs):
    rows = quality.judge(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    for _, own in rows.groupby(rows["lang"].fillna("none")):
        bins = np.sort(np.floor(own.loc[~own["base_failed"], "log_perplexity"] / quality.BIN))
        if not len(bins):
            continue
        q1, q3 = ((bins[math.ceil(q * len(bins)) - 1] + 0.5) * quality.BIN for q in (0.25, 0.75))
        n = np.array([len((t or "").encode()) for t in own.merge(docs.select("doc_id", "text").toPandas(), on="doc_id")["text"]])
        slack = quality.SHORT / np.sqrt(n + 1)
        low, high = q1 - quality.SPREAD * (q3 - q1) - slack, q3 + quality.SPREAD * (q3 - q1) + slack
        assert np.allclose(own["band_low"], low) and np.allclose(own["band_high"], high)
        inside = (own["log_perplexity"] >= low) & (own["log_perplexity"] <= high)
        assert (own["kept"] == (inside & ~own["base_failed"])).all()


def test_bands_reject_junk_and_keep_clean_text(spark, docs):
    junk = [(10**6 + i, " ".join(f"xq{j}zzkw#*{i}" for j in range(60)), "en") for i in range(3)]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    judged = {r["doc_id"]: r for r in quality.judge(table).collect()}
    assert not any(judged[10**6 + i]["kept"] for i in range(3))
    passed = [r for k, r in judged.items() if k < 10**6 and not r["base_failed"]]
    assert sum(r["kept"] for r in passed) > 0.85 * len(passed)


def test_stage_keeps_whole_rows(docs, odd, none):
    for table in (docs, odd):
        kept = quality.keep_good(table)
        assert kept.columns == table.columns
        verdicts = Counter(repr(r["doc_id"]) for r in quality.judge(table).collect() if r["kept"])
        assert Counter(repr(r["doc_id"]) for r in kept.collect()) == verdicts
    assert quality.judge(none).count() == quality.keep_good(none).count() == 0


def test_n_grams_that_are_not_sent_count_as_well(docs, odd, monkeypatch):
    for table in (docs, odd):
        found = []
        for bits in (60, 3):  # all n-grams are sent, or eight of them
            monkeypatch.setattr(quality, "SLOT_BITS", bits)
            found.append(sorted((repr(r["doc_id"]), r["kept"], round(r["log_perplexity"], 8)) for r in quality.judge(table).collect()))
        assert found[0] == found[1]
    monkeypatch.setattr(quality, "SLOT_BITS", 3)
    kept = Counter(r[0] for r in found[0] if r[1])
    assert Counter(repr(r["doc_id"]) for r in quality.keep_good(odd).collect()) == kept

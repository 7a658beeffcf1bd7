import re

import pytest

from ledgerloom.llm import url_filter as uf


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len((h + p).encode()), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    words = set(re.split(r"[.-]", host))
    return host, path, best and best[1], best[2] if best else "block" if not host or words & set(uf.BLOCK_WORDS) else "allow"


URLS = [
    None, "", "example.org/en/1", "http://", "http://Example.ORG/en/1234", "https://www.example.org/es/x?y#z", "ftp://notexample.org/en/1",
    "http://a.b.com/fr/", "http://com/fr", "http://com/de/1", "x://y.com/de/://z", "http://big-casino.net/a", "http://big.net?q=/fr/", "http://h.org#f",
    "http://ünï.com/fr/é", "http://example.org", "http://example.org/", "http://..org/x", "http://org./x", "http://a.com/" + "fr/" * 50000,
]


@pytest.fixture
def odd_pages(spark):
    rows = [(i, u, "h", "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.com/fr/", None, None, None), (3, "http://", "h", "x", "y")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, id string")


def answers(df):
    return sorted((repr(r["page_id"]), r["host"], r["path"], repr(r["rule"]), r["verdict"]) for r in df.collect())


def wanted(df, rules):
    return sorted((repr(r["page_id"]), h, p, repr(rule), v) for r in df.collect() for h, p, rule, v in [brute(r["url"], rules)])


def test_matches_brute_force(spark, sf_dir, odd_pages):
    for pages in (spark.read.parquet(f"{sf_dir}/pages.parquet"), odd_pages):
        assert answers(uf.filter_urls(pages)) == wanted(pages, uf.RULES)
    assert uf.filter_urls(odd_pages.limit(0)).count() == 0


def test_more_rules_than_are_shipped(spark, odd_pages, monkeypatch):
    rules = spark.createDataFrame(uf.RULES, "host string, path string, verdict string")
    assert answers(uf.filter_urls(odd_pages, rules)) == wanted(odd_pages, uf.RULES)
    monkeypatch.setattr(uf, "MAX_SHIPPED", 2)
    assert answers(uf.filter_urls(odd_pages, rules)) == wanted(odd_pages, uf.RULES)


def test_collisions_are_confirmed_by_the_string(tmp_path, monkeypatch):
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", lambda key: len(key))
    uf.DigestArray.write([("a.b", "/x", "block"), ("b.a", "/x", "allow"), ("c.c", "/yy", "block")], str(tmp_path / "f"))
    array = uf.DigestArray(str(tmp_path / "f"))
    keys = [b"a.b/x", b"b.a/x", b"c.b/x", b"c.c/yy", b"long enough to be past the end"]
    found = array.find(keys)
    assert [i >= 0 for i in found] == [True, True, False, True, False]
    assert [bool(array.blocks[i]) for i in found[[0, 1, 3]]] == [True, False, True]


def test_rules_of_a_host_alone(spark, odd_pages, monkeypatch):
    given = [("example.org", "", "block"), ("com", "", "allow"), ("y.com", "", "block"), ("a.b.com", "/fr/", "block"), ("H.org", "", "block"), ("", "", "allow")]
    for own in (given[:5], given, given[:1]):
        rules = spark.createDataFrame(own, "host string, path string, verdict string")
        want = wanted(odd_pages, [(h.lower(), p, v) for h, p, v in own])
        monkeypatch.setattr(uf, "MAX_SHIPPED", 5_000_000)
        assert answers(uf.filter_urls(odd_pages, rules)) == want
        monkeypatch.setattr(uf, "MAX_SHIPPED", 0)
        assert answers(uf.filter_urls(odd_pages, rules)) == want


def test_both_forms_take_characters_alike(spark, monkeypatch):
    urls = ["a\nb://x.é.com/über/1", "http://Ü.com/é", "http://x.com/é/\n?q", "x://y.com", None, "://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    given = [("com", "/é", "block"), ("é.com", "/über/", "block"), ("y.com", "", "block"), ("x.com", "/é/\n", "allow")]
    rules = spark.createDataFrame(given, "host string, path string, verdict string")
    mapped = answers(uf.filter_urls(pages, rules))
    monkeypatch.setattr(uf, "MAX_SHIPPED", 0)
    assert answers(uf.filter_urls(pages, rules)) == mapped == wanted(pages, given)

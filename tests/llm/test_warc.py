import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, slot string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def found(a, b):
    return sorted((repr(r["page_id"]), r["status"]) for r in warc.audit(a, b).collect())


def test_agreeing_replicas_have_nothing_to_report(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert found(pages, pages.repartition(5)) == []


def test_damage_is_located(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = warc.audit(pages, warc.damaged(pages)).collect()
    ids = [r["page_id"] for r in pages.select("page_id").collect()]
    wanted = sorted((i, "missing" if i % 211 == 3 else "corrupt") for i in ids if i % 211 == 3 or i % 101 == 7)
    assert sorted((r["page_id"], r["status"]) for r in rows) == wanted
    order = pages.orderBy("page_id").collect()
    start = {}
    at = 0
    for r in order:
        start[r["page_id"]] = at
        size = len(("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: " + r["url"] + "\r\nContent-Length: " + str(len(r["html"].encode())) + "\r\n\r\n" + r["html"] + "\r\n\r\n").encode())
        at += size
    assert all(r["start"] == start[r["page_id"]] for r in rows)


def test_nulls_repeats_and_extra_records(spark):
    a = pages_of(spark, [(1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (None, "u", "n"), (None, None, None), (3, None, "z"), (4, "u", ""), (5, "u", "L" * 300000)])
    b = pages_of(spark, [(1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (None, "u", "n"), (None, None, None), (3, "", "z"), (4, "u", None), (5, "u", "L" * 300000)])
    assert found(a, b) == []
    assert found(a, b.filter("page_id is not null")) == [("None", "missing")] * 2
    assert found(a.filter("page_id != 5"), b) == [("5", "extra"), ("None", "extra"), ("None", "extra")]
    changed = b.withColumn("html", F.when(F.col("page_id") == 5, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    assert found(a, changed) == [("5", "corrupt")]
    many = pages_of(spark, [(9, "u", str(i)) for i in range(60)])
    fewer = many.filter("html != '7'")
    assert found(many, fewer) == [("9", "missing")]
    assert found(a.limit(0), b.limit(0)) == []
    assert len(found(a, b.limit(0))) == 8


def test_root_is_that_of_the_hashes(spark):
    rows = warc.slots(warc.manifest(warc.leaves(pages_of(spark, [(i, "u", f"p{i}") for i in range(40)])), warc.leaves(pages_of(spark, []))))
    root = warc.tree(rows, "a")[0].collect()[0]["digest"]
    level = {r["slot"]: r["a"] for r in rows.collect()}
    for _ in range(warc.LEVELS):
        up = {}
        for parent in {k // warc.FANOUT for k in level}:
            own = sorted((k, v) for k, v in level.items() if k // warc.FANOUT == parent)
            up[parent] = hashlib.sha256(",".join(f"{k}:{v}" for k, v in own).encode()).hexdigest()
        level = up
    assert root == level[0]

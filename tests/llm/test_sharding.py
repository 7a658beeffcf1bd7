import hashlib

import pytest

from ledgerloom.llm import sharding


def brute(rows, limit):
    keyed = []
    for id_, text in rows:
        mark = f"{'null' if id_ is None else id_}:{'null' if text is None else hashlib.md5(text.encode()).hexdigest()}"
        keyed.append((id_, len((text or "").encode()), int(hashlib.md5(mark.encode()).hexdigest()[:15], 16)))
    out = []

    def split(own, depth, prefix):
        total = sum(r[1] for r in own)
        if total <= limit or depth == sharding.MAX_DEPTH:
            out.extend((repr(r[0]), r[1], prefix, depth, total, total > limit) for r in own)
            return
        for bit in (0, 1):
            part = [r for r in own if r[2] >> (59 - depth) & 1 == bit]
            if part:
                split(part, depth + 1, prefix + str(bit))

    if keyed:
        split(keyed, 0, "")
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 30, 60_000, 4_000, 500])
def test_matches_brute_force(docs, odd, limit):
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert sorted((repr(r[0]), *r[1:]) for r in map(tuple, sharding.shard(table, limit).collect())) == brute(rows, limit)


def test_native_plan(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_written_shards_hold_every_row(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "out"), 60_000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert len(list((tmp_path / "out").glob("shard=*"))) > 4


def test_empty_table(none):
    assert sharding.shard(none).count() == 0



def test_rows_that_share_an_id_are_written_once_each(spark, odd, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b b", 1), (1, "b b", 2), (None, None, 3)], "doc_id long, text string, shard long")
    for i, table in enumerate((rows, odd)):
        column = sharding.write_shards(table, str(tmp_path / str(i)), 2)
        assert column == "shard_"
        back = spark.read.parquet(str(tmp_path / str(i))).select(table.columns)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, table.collect()))

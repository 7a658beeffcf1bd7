from collections import Counter

import corpus_pipeline
from ledgerloom.llm import mixing, ngram_join, packing, quality


def test_stages_follow_one_another(spark, sf_dir, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
    packed = Counter(map(tuple, packing.pack(kept).select("doc_id", "start", "length", "ids_crc32").collect()))
    run = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(tuple, run.select("doc_id", "start", "length", "ids_crc32").collect())) == packed


def test_decisions_take_effect(spark, sf_dir, docs):
    good = quality.keep_good(docs)
    ids = {r["doc_id"] for r in good.collect()}
    assert ids == {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()} and len(ids) < docs.count()
    single = ngram_join.first_of_each(docs)
    classes = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs).collect()}
    assert {r["doc_id"] for r in single.collect()} == {k for k, v in classes.items() if k == v}
    taken = {r["doc_id"] for r in mixing.mix(docs).filter("taken > 0").collect()}
    assert {r["doc_id"] for r in mixing.sample(docs).collect()} == taken


def test_odd_rows_pass_every_stage(spark, sf_dir, odd, none):
    for table in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, sf_dir).count() >= 0

import os

import pytest

import corpus_pipeline
from tarnsearch.llm.decontam import exact_shingles
from tarnsearch.llm.neardup import shingle_set
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not there")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [exact_shingles(r.text.encode(), 5) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, now = now, corpus_pipeline.materialize(stage(spark, now, FOLDER), name)
        assert now.columns == docs.columns and {r.doc_id for r in now.collect()} <= {r.doc_id for r in before.collect()}
    left = {r.doc_id: r.text.encode() for r in now.collect()}
    assert all(len(t.split()) >= 20 for t in left.values())
    sets = {i: shingle_set(t, 5) for i, t in left.items()}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert not near
    assert not any(100 * len(i & exact_shingles(t, 5)) >= 80 * len(i) for i in items for t in left.values())
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert {r.doc_id for r in rows} <= set(left) and {r.shard for r in rows} <= set(range(40))
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, docs, name, stage):
    assert stage(spark, docs([]), FOLDER).count() == 0
    assert set(docs(ODD).columns) <= set(stage(spark, docs(ODD), FOLDER).columns)
    stage(spark, docs(ODD), FOLDER).count()


def test_columns_of_the_same_names_stay(spark, odd):
    from pyspark.sql import functions as F

    given = odd.withColumn("shard", F.lit("mine")).withColumn("Slot", F.lit("mine"))
    out = corpus_pipeline.shards(spark, given, FOLDER)
    assert out.columns == [*given.columns, "shard__", "slot_"] and out.where("shard <> 'mine'").count() == 0

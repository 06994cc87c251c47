"""The pipeline: stages in order, each with the columns of documents, its decisions effective."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from donorlake.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = {}
    names = [name for name, _ in corpus_pipeline.STAGES]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, now, DIR)
        now = spark.createDataFrame(result.collect(), result.schema)
        seen[name] = now
        if name != names[-1]:
            assert now.columns == docs.columns
    good = {r.doc_id for r in QUERIES["op9_quality_rules"](spark, DIR).filter("kept").collect()}
    assert {r.doc_id for r in seen[names[0]].collect()} == good
    ids = [r.doc_id for r in seen[names[1]].collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= good
    assert sorted(r.doc_id for r in seen[names[2]].collect()) == sorted(ids)
    assert seen[names[2]].filter(F.col("text").rlike(r"@[a-z0-9-]+\.[a-z]")).count() == 0
    assert {r.doc_id for r in seen[names[3]].collect()} <= set(ids)
    packed = seen[names[4]].filter("piece = 0").groupBy("doc_id").count().collect()
    mixed = {r.doc_id: r["count"] for r in seen[names[3]].groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in packed} == mixed


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DIR)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0

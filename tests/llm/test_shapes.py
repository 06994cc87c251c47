"""Every operator on odd rows, on no rows, and every query on the small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from donorlake.llm import language_id, language_model, mixing, nearest, ngram_join, packing, personal_data, quality_rules, toxicity, url_filter
from donorlake.llm.queries import QUERIES

from .helpers import SCHEMA, frame, odd_rows

LABELS = "doc_id long, quality int, toxic int"
ON_DOCUMENTS = {
    "language": lambda spark, docs: language_id.predict(docs),
    "mix": lambda spark, docs: mixing.draw(docs),
    "personal": lambda spark, docs: personal_data.find(docs),
    "join": lambda spark, docs: ngram_join.link(docs),
    "toxicity": lambda spark, docs: toxicity.predict(docs, spark.createDataFrame([(1, 1, 1), (5, 1, None)], LABELS)),
    "quality": lambda spark, docs: quality_rules.judge(docs),
    "model": lambda spark, docs: language_model.predict(docs),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_rows_give_one_row_each_and_none_give_none(spark, name):
    rows = odd_rows()
    assert ON_DOCUMENTS[name](spark, frame(spark, rows)).count() == len(rows)
    assert ON_DOCUMENTS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_and_addresses_on_odd_and_no_rows(spark):
    packed = packing.pack(frame(spark, odd_rows())).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in packed}) == len(packed) >= len(odd_rows())
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    schema = "page_id long, url string, host string, rule int"
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "x://b.net/es/?q", "http://" + "a" * 50_000 + "/" + "b" * 50_000]
    judged = url_filter.judge(spark.createDataFrame([(k, u, "mine", 1) for k, u in enumerate(urls)], schema)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in judged[:6]] == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.com", "", None, "allow"),
        ("b.net", "/es/", "net/es/", "block"),
    ]
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [0.9, 0.1]),
        (1, [0.9, 0.1]),
        (2, [0.0, 0.0]),
        (3, None),
        (4, [float("nan"), 1.0]),
        (5, [None, 1.0]),
        (None, [1.0, 0.0]),
        (6, [-1.0, 0.0]),
        (7, [1.0, 0.0, 0.0]),
        (100, [1.0, 0.0]),
        (8, []),
    ]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, vec int")
    found = nearest.nearest(table, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 100), (0, 2, 1), (0, 3, 6), (100, 1, 0), (100, 2, 1), (100, 3, 6)]
    assert nearest.nearest(table.limit(0), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_an_id_with_very_many_rows_stays_within_the_sample(spark):
    docs = spark.range(3_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    texts, langs = language_id.sample(docs, F.lit(True), rows=50)
    assert len(texts) == len(set(texts)) == len(langs) == 50
    assert (texts, langs) == language_id.sample(docs.repartition(5, "text"), F.lit(True), rows=50)


def test_labelled_rows_are_limited_ahead_of_the_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(toxicity.F, "broadcast", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("one text.").alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    texts, marks = toxicity.sample(docs, labels, F.lit(True))
    assert len(texts) == 100 and sum(marks) == 50
    assert plans[0].count("TakeOrderedAndProject") == 2

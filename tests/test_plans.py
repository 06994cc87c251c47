"""Plan shapes that decide whether a job holds at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from donorlake.bindings import inputs
from donorlake.bindings.queries import QUERIES
from donorlake.operators import folds, running
from donorlake.plans import counters, ledger


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(name for name in QUERIES if not name.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_single_task_windows(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text or "TakeOrderedAndProject" in text
    assert "RoundRobinPartitioning" not in text


@pytest.mark.parametrize("name", ["receipts_outbox", "metadata_table"])
def test_each_log_is_read_once(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    # The orders make the payment log and, with the events, the request log.
    assert text.count("FileScan parquet") == 3 and text.count("user_id#") > 0
    assert text.count("from_json") <= 5


def test_last_write_prunes_before_its_one_shuffle(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "orders")
    text = plan(folds.last_write(rows, "o_custkey", ["o_orderdate", "o_orderkey"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("WindowGroupLimit") == 2


def test_counts_combine_on_the_map_side(spark, sf_dir):
    text = plan(counters.counts(inputs.metric_events(inputs.table(spark, sf_dir, "events")), "1 hour"))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("HashAggregate") == 2


def test_running_values_are_partitioned_by_key_and_chunk(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    text = plan(running.sessions(events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 1800, F.date_trunc("day", F.col("ts"))))
    assert re.search(r"hashpartitioning\(user_id#\d+L, _chunk#\d+", text)


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(entry.queries()["metric_counts"](spark, sf_dir))
    (schema,) = set(re.findall(r"ReadSchema: (\S+)", text))
    assert "value" not in schema.replace("event_type", "") and "event_type" in schema


def test_documents_are_parsed_once_even_under_a_filter(spark, sf_dir):
    hooks = ledger.parsed(ledger.triage(inputs.stripe_hooks(inputs.table(spark, sf_dir, "orders"))))
    text = hooks._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1


def test_accounts_make_and_read_documents_once(spark, sf_dir):
    from donorlake.bindings import queries

    plan = queries.QUERIES["contribution_accounts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "from_json" not in plan

"""Operators against brute force, with one key that holds a third of the rows."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from donorlake import fixed_values as fixed
from donorlake.operators import allocation, folds, lookups, running, sticky

START = dt.datetime(2024, 1, 1)


def log(spark, n=3000, seed=1):
    """(key, ts, id, value): a third of the rows belong to "hot", some keys are null, many values are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(40)}")
        ts = START + dt.timedelta(seconds=rng.randrange(40 * 86400))
        rows.append((key, ts, i, rng.choice([None, None, "a", "b", "c"]), f"first{i}" if i % 5 else None))
    return spark.createDataFrame(rows, "key string, ts timestamp, id bigint, value string, first string").repartition(6)


ORDER = ["ts", "id"]


def sort_key(row):
    return (row["ts"], row["id"])


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_last_write(spark):
    df = log(spark)
    got = {(r["key"], r["id"]) for r in folds.last_write(df, "key", ORDER).collect()}
    newest = {}
    for r in sorted(df.collect(), key=sort_key):
        newest[r["key"] if r["key"] is not None else ("null", r["id"])] = (r["key"], r["id"])
    assert got == set(newest.values())


def test_last_write_of_batches_is_last_write_of_all(spark):
    df = log(spark)
    parts = [df.where(F.col("id") % 3 == i) for i in range(3)]
    folded = [folds.last_write(p, "key", ORDER) for p in parts]
    union = folded[2].unionByName(folded[0]).unionByName(folded[1]).unionByName(folded[0])
    again = folds.last_write(union, "key", ORDER)
    assert same(again, folds.last_write(df, "key", ORDER))


def test_merge_newest(spark):
    df = log(spark)
    got = {r["key"]: r for r in folds.merge_newest(df, "key", ORDER, ["value"], ["first"], "ts").where("key is not null").collect()}
    want = {}
    for r in sorted(df.where("key is not null").collect(), key=sort_key):
        state = want.setdefault(r["key"], {"value": None, "first": r["first"], "ts": None})
        state["value"] = r["value"] if r["value"] is not None else state["value"]
        state["ts"] = r["ts"]
    assert set(got) == set(want)
    for key, state in want.items():
        assert (got[key]["value"], got[key]["first"], got[key]["updated"]) == (state["value"], state["first"], state["ts"])


def test_merge_newest_keeps_rows_without_a_key_apart(spark):
    df = log(spark)
    merged = folds.merge_newest(df, "key", ORDER, ["value"], ["first"], "ts")
    assert merged.where("key is null").count() == df.where("key is null").count()


def test_merge_partials_in_any_order_and_twice(spark):
    df = log(spark)
    args = ("key", ["value"], ["first"])
    part = lambda i: folds.newest_partials(df.where(F.col("id") % 3 == i), "key", ORDER, ["value"], ["first"], "ts")
    state = part(2).unionByName(part(0)).unionByName(part(1)).unionByName(part(2))
    got = folds.finish_partials(folds.merge_partials(state, *args), *args)
    assert same(got, folds.merge_newest(df, "key", ORDER, ["value"], ["first"], "ts"))


def test_carry_forward(spark):
    df = log(spark).where("key is not null")
    whole = Window.partitionBy("key").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("out", F.last("value", ignorenulls=True).over(whole))
    for unit in ("hour", "day", "month"):
        assert same(running.carry_forward(df, "key", ORDER, "value", F.date_trunc(unit, F.col("ts")), "out"), want)


def test_previous_row(spark):
    df = log(spark).where("key is not null")
    along = Window.partitionBy("key").orderBy(*ORDER)
    want = df.withColumns({"previous_value": F.lag("value").over(along), "previous_id": F.lag("id").over(along)})
    got = running.previous_row(df, "key", ORDER, ["value", "id"], F.date_trunc("day", F.col("ts")))
    assert same(got.select(want.columns), want)


def test_a_burst_is_dealt_in_chunks_of_a_number_of_rows(spark):
    """One key with nearly all rows, all within a second, and some small keys."""
    hour = F.timestamp_seconds(F.lit(1_700_000_000))
    df = spark.range(60_000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 7)).otherwise("hot").alias("key"),
        hour.alias("ts"), ((F.col("id") * 48_271) % 60_013).alias("id"), (F.col("id") % 11).alias("value"),
    )
    chunks = running.dealt(df, "key", ["ts", "id"], 5_000)
    sizes = [r["count"] for r in chunks.groupBy("key", "_chunk").count().collect()]
    assert max(sizes) <= 10_000 and sum(sizes) == 60_000
    along = Window.partitionBy("key").orderBy("ts", "id")
    want = df.withColumns({"previous_value": F.lag("value").over(along), "previous_id": F.lag("id").over(along)})
    got = running.previous_row(chunks, "key", ["ts", "id"], ["value", "id"], F.col("_chunk"))
    assert same(got.select(want.columns), want)
    assert running.dealt(df.limit(0), "key", ["ts", "id"]).count() == 0


def test_sessions(spark):
    df = log(spark).where("key is not null")
    want = set()
    by_key = {}
    for r in df.collect():
        by_key.setdefault(r["key"], []).append(r["ts"])
    for key, times in by_key.items():
        times.sort()
        current, number = [times[0]], 1
        for t in times[1:]:
            if (t - current[-1]).total_seconds() > 5400:
                want.add((key, number, current[0], current[-1], len(current)))
                current, number = [], number + 1
            current.append(t)
        want.add((key, number, current[0], current[-1], len(current)))
    for unit in ("hour", "day"):
        got = running.sessions(df, "key", "ts", 5400, F.date_trunc(unit, F.col("ts")))
        assert {(r["key"], r["session_no"], r["started"], r["ended"], r["n_events"]) for r in got.collect()} == want


def test_look_up_left_keeps_every_row_and_spreads_nulls(spark):
    df = log(spark)
    table = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "name string, n int")
    got = lookups.look_up_left(df, table, F.col("key"), "name", F.col("id"))
    want = df.join(table, df["key"] == table["name"], "left").drop("name")
    assert same(got.select(want.columns), want)
    assert got.where("key is null and n is not null").count() == 0


def test_a_repeated_key_counts_once(spark):
    table = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("b", 1, "y"), ("b", 1, "y"), (None, 1, "n")], "key string, n int, t string")
    got = {(r["key"], r["n"], r["t"]) for r in folds.one_per_key(table, "key").collect()}
    assert got == {("a", 1, "z"), ("b", 1, "y")}
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, id int")
    assert lookups.look_up_left(facts, table, F.col("k"), "key", F.col("id")).count() == 4


def greedy(times, life):
    out, current = {}, None
    for t in sorted(times):
        if current is None or t >= current + life:
            current = t
        out[current] = out.get(current, 0) + 1
    return out


def test_sticky_assignments(spark):
    df = log(spark).where("key is not null")
    got = {(r["browser_id"], r["assigned_second"]): r["n_requests"] for r in sticky.assignments(df, "key", "ts").collect()}
    want, times = {}, {}
    for r in df.select("key", F.unix_seconds("ts").alias("s")).collect():
        times.setdefault(r["key"], []).append(r["s"])
    for key, seconds in times.items():
        want.update({(key, start): n for start, n in greedy(seconds, 604800).items()})
    assert got == want


def test_sticky_scan_carries_over_batches():
    import pandas as pd

    seconds = list(range(0, 100, 3))
    whole = pd.DataFrame({"browser_id": "b", "second": seconds, "n": 1})
    other = pd.DataFrame({"browser_id": "c", "second": [5, 6], "n": 1})
    cuts = [whole.iloc[:7], whole.iloc[7:8], whole.iloc[0:0], pd.concat([whole.iloc[8:], other])]
    got = pd.concat(sticky.scan_assignments(10)(iter(cuts)))
    totals = got[got.browser_id == "b"].groupby("assigned_second").n_requests.sum().to_dict()
    assert totals == greedy(seconds, 10)
    assert list(got[got.browser_id == "c"].assigned_second) == [5, 5]


def test_test_ids_are_stable_and_in_range(spark):
    df = spark.range(2000).select(sticky.test_id(F.col("id").cast("string"), F.lit(7)).alias("t"))
    low, high, n = df.agg(F.min("t"), F.max("t"), F.countDistinct("t")).first()
    assert 0 <= low < 100 and 9900 < high < 10000 and n > 1500


# --- allocation over all ids ---------------------------------------------------------------------------------------------


def test_every_id_of_a_range_is_allocated_and_no_other(spark):
    ids = spark.range(10001).select(F.col("id").cast("int").alias("test_id"))
    tests = [
        allocation.Experiment("all", 100, 0, ("x",)),
        allocation.Experiment("mid", 20, 30, ("a", "b", "c")),
        allocation.Experiment("odd", 12.34, 5.67, ("a", "b")),
        allocation.Experiment("never", 100, 0, ("x",), "false"),
    ]
    rows = allocation.allocations(ids, experiments=tests).select("test_id", F.explode("allocations").alias("a")).select("test_id", "a.*").collect()
    for t in tests:
        got = {r["test_id"]: r["variantName"] for r in rows if r["testName"] == t.name}
        inside = range(t.start_id + 1, t.end_id + 1) if t.can_run == "true" else ()
        assert got == {i: t.variants[i % len(t.variants)] for i in inside}
    assert not any(r["test_id"] == 0 for r in rows)


def test_landing_pattern_is_loose(spark):
    whole = fixed.LANDING_PATTERN.rpartition("(")[2].rstrip(")")
    codes = ["any_thrasher_y", "z_ge2017_interactive_slice", whole, "other", None]
    df = spark.createDataFrame([(5, c) for c in codes], "test_id int, intcmp string")
    got = allocation.allocations(df).select("intcmp", F.size("allocations").alias("n")).collect()
    assert {r["intcmp"]: r["n"] for r in got} == {**dict.fromkeys(codes[:3], 2), "other": 1, None: 1}


def test_forced_allocation_replaces_everything(spark):
    asked = ["Landing Page=WITH-COPY", "stripe-checkout=stripe=more", "stripe-checkout=none", "stripe-checkout=", "x", None]
    df = spark.createDataFrame([(0, None, a) for a in asked], "test_id int, intcmp string, ab string")
    got = allocation.allocations(df, parameter="ab").select("ab", F.col("allocations.testSlug").alias("t")).collect()
    assert [r["t"] for r in got] == [["landing-page"], ["stripe-checkout"], [], [], [], []]


def test_experiments_can_come_as_rows(spark):
    (one,) = allocation.experiments_from_rows([{"name": "T", "size": 10, "offset": 0, "variants": ["v"], "can_run": "k = 1"}])
    df = spark.createDataFrame([(5, 1), (5, 2)], "test_id int, k int")
    got = allocation.allocations(df, experiments=[one]).select("k", F.size("allocations").alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {1: 1, 2: 0}


def test_event_pair_and_registration_use_name_and_slug(spark):
    t = allocation.Experiment("My Test", 100, 0, ("Some Variant",))
    df = allocation.allocations(spark.createDataFrame([(5,)], "test_id int"), experiments=[t])
    row = df.select(
        allocation.event_tests(F.col("allocations")).alias("pair"), allocation.registration(F.col("allocations"), True).alias("reg")
    ).first()
    assert row["pair"][0].asDict() == {"name": "my-test", "variant": "Some Variant"}
    assert row["reg"]["my-test"].asDict() == {"variantName": "some-variant", "complete": "true"}

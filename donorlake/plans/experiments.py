"""Experiment reports over allocated visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from donorlake.operators.allocation import event_tests


def allocation_rows(visitors: DataFrame, *keep: str) -> DataFrame:
    """One row per visitor and test, with the event pair it is reported as."""
    pair = F.explode(F.arrays_zip("allocations", event_tests(F.col("allocations")).alias("pair")))
    return visitors.select(*keep, pair.alias("_a")).select(
        *keep, F.col("_a.allocations.*"), F.col("_a.pair.name").alias("event_test"), F.col("_a.pair.variant").alias("event_variant")
    )


def exposure(visitors: DataFrame, visitor: str, paid: str) -> DataFrame:
    """Visitors and payers per test and variant.

    Requests are folded to one row per visitor and variant on the map side, so neither a busy visitor nor a variant that
    everyone is in costs more than its distinct visitors.
    """
    seen = allocation_rows(visitors, visitor, paid).groupBy("testSlug", "variantName", visitor).agg(
        F.max(F.col(paid).cast("int")).alias("paid")
    )
    return (
        seen.groupBy("testSlug", "variantName")
        .agg(F.count("*").alias("visitors"), F.sum("paid").alias("payers"))
        .withColumn("rate", F.try_divide(F.col("payers").cast("double"), F.col("visitors").cast("double")))
    )


def approximate_exposure(visitors: DataFrame, visitor: str, relative_error: float = 0.02) -> DataFrame:
    """Visitors per test and variant from sketches: no per-visitor shuffle at all."""
    return (
        allocation_rows(visitors, visitor)
        .groupBy("testSlug", "variantName")
        .agg(F.approx_count_distinct(visitor, relative_error).alias("visitors"))
    )


def daily_sketches(visitors: DataFrame, visitor: str, time: str, bits: int = 12) -> DataFrame:
    """Visitors per test, variant and day as sketches that add up: a kept day is never counted again.

    A sketch has a bounded size (2^bits registers); its relative error is about 1.04 / sqrt(2^bits).
    """
    rows = allocation_rows(visitors, visitor, time)
    return rows.groupBy("testSlug", "variantName", F.to_date(time).alias("day")).agg(
        F.hll_sketch_agg(visitor, F.lit(bits)).alias("visitors")
    )


def exposure_of_sketches(days: DataFrame, *keys: str) -> DataFrame:
    """Distinct visitors over all given days, per test and variant (and further keys), from the days' sketches."""
    return days.groupBy("testSlug", "variantName", *keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors")
    )

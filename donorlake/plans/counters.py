"""Operational counters and the rates made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.plans.ledger import INVALID, PARSED

DIMENSIONS = ("name", "payment_provider", "platform")


def provider_dimension(provider: Column) -> Column:
    return F.coalesce(provider, F.lit(fixed.UNKNOWN_PROVIDER))


def hook_metrics(hooks: DataFrame) -> DataFrame:
    """The counters one hook adds to: an attempt, how it parsed, how it was processed.

    ``hooks`` has outcome, processing_error (null when processed), provider, platform and received_at.
    """
    ok = F.col("outcome") == PARSED
    how = (
        F.when(ok, "payment-hook-parsed")
        .when(F.col("outcome") == INVALID, "contribution-paypal-hook-invalid-request")
        .otherwise("payment-hook-parse-error")
    )
    done = F.when(ok & F.col("processing_error").isNull(), "payment-hook-processed").when(
        ok, "payment-hook-processing-error"
    )
    names = F.array_compact(F.array(F.lit("payment-hook-attempt"), how, done))
    return hooks.select(
        F.col("received_at").alias("ts"), F.explode(names).alias("name"), F.col("provider").alias("payment_provider"), "platform"
    )


def counts(metrics: DataFrame, window: str = "1 minute") -> DataFrame:
    """Data points per window, metric, provider and platform."""
    return (
        metrics.groupBy(F.window("ts", window).alias("_w"), *DIMENSIONS)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), *DIMENSIONS, "n")
    )


def rates(metrics: DataFrame) -> DataFrame:
    """Success rates per provider, and whether every hook attempt is accounted for."""
    table = metrics.groupBy("payment_provider").pivot("name", list(fixed.METRIC_NAMES)).agg(F.count(F.lit(1)))
    n = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(0))
    rate = lambda part, whole: F.try_divide(n(part).cast("double"), n(whole).cast("double"))
    attempts = n("payment-hook-attempt")
    accounted = n("payment-hook-parsed") + n("payment-hook-parse-error") + n("contribution-paypal-hook-invalid-request")
    return table.select(
        "payment_provider",
        n("payment-attempt").alias("payment_attempts"),
        rate("payment-authorisation-success", "payment-authorisation-attempt").alias("authorisation_rate"),
        rate("payment-success", "payment-attempt").alias("payment_rate"),
        attempts.alias("hook_attempts"),
        rate("payment-hook-parsed", "payment-hook-attempt").alias("parse_rate"),
        rate("payment-hook-processed", "payment-hook-parsed").alias("processing_rate"),
        (attempts == accounted).alias("all_accounted"),
    )


def payment_errors(errors: DataFrame) -> DataFrame:
    """Provider errors by type; a declined instrument is the payer's affair and only a warning."""
    from donorlake.functions.text import paypal_error_message, paypal_error_type

    kind = paypal_error_type(F.col("error_name"))
    return (
        errors.withColumns({"error_type": kind, "message": paypal_error_message(F.col("error_message"))})
        .withColumn("severity", F.when(F.col("error_type") == "InstrumentDeclined", "warning").otherwise("error"))
        .groupBy("error_type", "severity", "message")
        .agg(F.count("*").alias("n"))
    )

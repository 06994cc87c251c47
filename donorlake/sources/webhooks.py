"""PayPal and Stripe webhook documents.

Both readers take any frame with the raw document in one column (``spark.read.text``, ``readStream.text`` or a table)
and keep all its other columns. They add the fields and ``problem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions import money
from donorlake.functions.documents import ISO_TIME, UUID, Field, one_of, read_documents
from donorlake.schemas import MONEY

PAYPAL_HOOK = [
    Field("resource", "$.resource", "object"),
    Field("custom", "$.resource.custom", required=False, then=UUID),
    Field("parent_payment", "$.resource.parent_payment"),
    Field("create_time", "$.resource.create_time", then=ISO_TIME),
    Field("currency", "$.resource.amount.currency"),
    Field("total", "$.resource.amount.total", "number"),
    Field("event_type", "$.event_type", then=one_of(fixed.PAYPAL_EVENT_STATUS)),
]

STRIPE_HOOK = [
    Field("event_id", "$.id"),
    Field("payload", "$.data.object", "object"),
    Field("metadata", "$.data.object.metadata", "object"),
    Field("contribution_id", "$.data.object.metadata.contributionId", then=UUID),
    Field("payment_id", "$.data.object.id"),
    Field("livemode", "$.data.object.livemode", "flag"),
    Field("created_epoch", "$.data.object.created", "whole"),
    Field("currency", "$.data.object.currency"),
    Field("amount_minor", "$.data.object.amount", "whole"),
    Field("charge_status", "$.data.object.status", then=one_of(fixed.STRIPE_STATUS)),
    Field("email", "$.data.object.metadata.email"),
    Field("refunded", "$.data.object.refunded", "flag"),
    Field("country_code", "$.data.object.metadata.countryCode"),
]


def read_paypal_hooks(raw: DataFrame, document: str = "document", mode: str = "Default") -> DataFrame:
    """PayPal hooks: currency as sent, no email, no converted amount, mode given by the feed."""
    parsed = read_documents(raw, document, PAYPAL_HOOK)
    return parsed.select(
        *raw.columns,
        "problem",
        F.col("custom").alias("contributionid"),
        F.col("parent_payment").alias("paymentid"),
        F.lit("Paypal").alias("provider"),
        F.col("create_time").alias("created"),
        "currency",
        F.round("total", 2).cast(MONEY).alias("amount"),
        F.col("event_type").alias("status"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("event_id"),
        F.lit(mode).alias("mode"),
        F.lit(None).cast("string").alias("country_code"),
    )


def read_stripe_hooks(raw: DataFrame, document: str = "document") -> DataFrame:
    """Stripe hooks: currency upper-cased, minor units to major, refunds override the charge status."""
    parsed = read_documents(raw, document, STRIPE_HOOK)
    return parsed.select(
        *raw.columns,
        "problem",
        F.col("contribution_id").alias("contributionid"),
        F.col("payment_id").alias("paymentid"),
        F.lit("Stripe").alias("provider"),
        F.timestamp_seconds("created_epoch").alias("created"),
        F.upper("currency").alias("currency"),
        money.from_minor(F.col("amount_minor")).alias("amount"),
        F.when(F.col("refunded"), "Refunded").otherwise(F.col("charge_status")).alias("status"),
        "email",
        "event_id",
        F.when(F.col("livemode"), "Default").otherwise("Testing").alias("mode"),
        "country_code",
    )

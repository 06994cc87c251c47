"""Measurement hits of browsers: page views, events, checkout steps and purchases, as one log of documents.

A checkout step and a purchase are events that carry a product action, so what a hit is follows from its document.
Documents are read like webhooks: a field of the wrong type or out of its range rejects the hit, and so does a field
that its kind needs and that is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions.documents import Field, one_of, read_documents

PAGE_VIEW, EVENT, CHECKOUT, PURCHASE = "pageview", "event", "checkout", "purchase"


def _same(*names: str) -> str:
    return one_of({name: name for name in names})


HIT = [
    Field("hit_type", "$.hitType", then=_same(PAGE_VIEW, EVENT)),
    Field("pageview_id", "$.pageviewId"),
    Field("browser_id", "$.clientId"),
    Field("category", "$.eventCategory", required=False),
    Field("action", "$.eventAction", required=False),
    Field("label", "$.eventLabel", required=False),
    Field("value", "$.eventValue", "whole", required=False),
    Field("product_action", "$.productAction", required=False, then=_same(CHECKOUT, PURCHASE)),
    Field("step", "$.step", "whole", required=False, then=f"CASE WHEN {{v}} IN ({', '.join(map(str, fixed.CHECKOUT_STEPS))}) THEN {{v}} END"),
    Field("price", "$.revenue", "number", required=False),
    Field("currency", "$.currency", required=False, then="upper({v})"),
]

#: What a kind needs beyond the fields of every hit, in the order in which an absent one is named.
NEEDED = {PAGE_VIEW: (), EVENT: ("category", "action"), CHECKOUT: ("category", "action", "step"), PURCHASE: ("price", "currency")}


def hit_kind() -> Column:
    return F.when(F.col("hit_type") == PAGE_VIEW, PAGE_VIEW).otherwise(F.coalesce("product_action", F.lit(EVENT)))


def read_hits(log: DataFrame, document: str = "document") -> DataFrame:
    """All rows of the log with the fields of their hit, its ``kind``, and ``problem``: null, or the first reason against it.

    A rejected hit has no kind. The text stays, for dead letters.
    """
    read = read_documents(log, document, HIT)
    absent = [F.when((hit_kind() == kind) & F.col(name).isNull(), name) for kind, names in NEEDED.items() for name in names]
    read = read.withColumns({"problem": F.coalesce("problem", *absent)})
    return read.withColumns({"kind": F.when(F.col("problem").isNull(), hit_kind())})


def rejected(hits: DataFrame, document: str = "document") -> DataFrame:
    """Hits that were turned away, in the form of the dead letters of other feeds."""
    return hits.where(F.col("problem").isNotNull()).select(
        F.col(document).alias("raw"), F.lit("beacon").alias("feed"), F.col("problem").alias("reason"), F.lit("parse-error").alias("stage")
    )

"""Attribution table, contributor master table and the receipt and consent feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions.stages import computed_once
from donorlake.functions.text import blank_to_null, look_up, uuid_text
from donorlake.operators import folds
from donorlake.plans.visitors import state_accepted
from donorlake.schemas import ALLOCATION, CONTRIBUTION_METADATA
from donorlake.sources.requests import id_field
from pyspark.sql.types import ArrayType

ARRIVAL = ("received_at", "delivery_id")
NEWEST = ("name", "firstname", "lastname", "iduser", "postcode")
OLDEST = ("contributor_id",)
_METADATA = [f.name for f in CONTRIBUTION_METADATA.fields]


_REQUEST = [
    "cmp", "intcmp", "referrer_pageview_id", "referrer_url", "pageview_id", "browser_id", "visit_id", "iduser",
    "platform", "component_id", "component_type", "source", "referrer_test", "native_tests", "is_support", "allocations",
]
NOT_APPROVED, NO_REQUEST, NOT_STORABLE, NOT_STORED, STORED = "not approved", "no request", "not storable", "not stored", "stored"
REJECTED, REPEATED, PAID, UNPAID = "rejected", "repeated", "paid", "no payment"


def usable(requests: DataFrame, *more: str) -> DataFrame:
    """Requests that are good, by payment source and payment."""
    good = requests.where(F.col("problem").isNull() & F.col("paymentid").isNotNull())
    return good.select("kind", "paymentid", F.col("name").alias("asked_name"), F.col("postcode").alias("asked_postcode"), *_REQUEST, *more)


def with_details(matched: DataFrame) -> DataFrame:
    """Payments next to their requests (``requested``), or next to nulls, as contributions.

    A card payment takes name and postcode from its form, a PayPal payment brings its own.
    """
    card = F.col("kind") == "stripe"
    path = F.substring_index("kind", "-", -1)
    return matched.withColumns(
        {
            "provider": F.when(card, "Stripe").otherwise("Paypal"),
            "contributionid": F.when(card, F.col("given_id")).otherwise(uuid_text(F.col("custom"))),
            "name": F.when(card, F.col("asked_name")).otherwise(F.col("name")),
            "postcode": F.when(card, F.col("asked_postcode")).otherwise(F.col("postcode")),
            "amount": F.when(card, F.col("amount")).otherwise(F.col("total")),
            "approved": card | F.coalesce(state_accepted(F.col("state"), path), F.lit(False)),
            "requested": F.coalesce("requested", F.lit(False)),
        }
    ).drop("given_id", "asked_name", "asked_postcode")


def contributions(payments: DataFrame, requests: DataFrame) -> DataFrame:
    """Every payment once, with the request that made it where there is a good one; a repeated request counts once."""
    asked = folds.one_per_key(usable(requests), "kind", "paymentid").withColumn("requested", F.lit(True))
    return with_details(payments.join(asked, ["kind", "paymentid"], "left"))


def missing() -> Column:
    """The first thing a contribution lacks that the tables and the receipts need."""
    return (
        F.when(F.col("contributionid").isNull(), "contribution id")
        .when(F.col("email").isNull(), "payer")
        .when(F.col("amount").isNull(), "amount")
    )


def with_outcomes(contributions: DataFrame, stored: Column) -> DataFrame:
    """Add ``outcome`` and ``reason``, so that every payment is in the tables or is told why not."""
    outcome = (
        F.when(~F.col("approved"), NOT_APPROVED)
        .when(~F.col("requested"), NO_REQUEST)
        .when(missing().isNotNull(), NOT_STORABLE)
        .when(~stored, NOT_STORED)
        .otherwise(STORED)
    )
    told = contributions.withColumns({"outcome": outcome})
    return told.withColumns({"reason": F.when(F.col("outcome") == NOT_STORABLE, missing()).otherwise(F.col("outcome"))})


def paid_for(contributions: DataFrame) -> DataFrame:
    """Payments that went through and have a request: what acquisitions, tables and receipts are made of."""
    return contributions.where(F.col("approved") & F.col("requested"))


def accounts(contributions: DataFrame, payments: DataFrame, requests: DataFrame, stored: Column) -> DataFrame:
    """How many payments and requests of each kind came to what: ``side, kind, outcome, reason, n``.

    Rows of a side add up to the rows that came in.
    """
    paid = with_outcomes(contributions, stored).groupBy("kind", "outcome", "reason").agg(F.count("*").alias("n"))
    bad = requests.where(F.col("problem").isNotNull() | F.col("paymentid").isNull())
    bad = bad.groupBy("kind", F.lit(REJECTED).alias("outcome"), F.coalesce("problem", F.lit("paymentid")).alias("reason"))
    asked = folds.one_per_key(usable(requests).select("kind", "paymentid", F.lit(1).alias("one")), "kind", "paymentid", count="times")
    known = folds.one_per_key(payments.select("kind", "paymentid", F.lit(True).alias("known")), "kind", "paymentid")
    came = asked.join(known, ["kind", "paymentid"], "left").withColumns({"outcome": F.when(F.col("known"), PAID).otherwise(UNPAID)})
    came = came.groupBy("kind", "outcome").agg(F.count("*").alias("n"), F.sum(F.col("times") - 1).alias("again"))
    again = came.groupBy("kind").agg(F.sum("again").alias("n")).select("kind", F.lit(REPEATED).alias("outcome"), F.lit(REPEATED).alias("reason"), "n")
    came = came.select("kind", "outcome", F.col("outcome").alias("reason"), "n")
    requested = bad.agg(F.count("*").alias("n")).unionByName(came).unionByName(again.where("n > 0"))
    return paid.withColumn("side", F.lit("payment")).unionByName(requested.withColumn("side", F.lit("request")))


def dead_letters(contributions: DataFrame, requests: DataFrame, stored: Column) -> DataFrame:
    """Requests that were rejected and payments that reached no table, with their text: ``raw, feed, reason, stage``."""
    bad = requests.where(F.col("problem").isNotNull() | F.col("paymentid").isNull())
    bad = bad.select(F.col("document").alias("raw"), F.col("kind").alias("feed"), F.coalesce("problem", F.lit("paymentid")).alias("reason"), F.lit("request").alias("stage"))
    return bad.unionByName(lost_payments(contributions, stored))


def lost_payments(contributions: DataFrame, stored: Column) -> DataFrame:
    """Payments that reached no table: ``raw, feed, reason, stage``."""
    lost = with_outcomes(contributions, stored).where(F.col("outcome") != STORED)
    return lost.select(F.col("document").alias("raw"), F.col("kind").alias("feed"), "reason", F.lit("payment").alias("stage"))


def storable(contributions: DataFrame) -> DataFrame:
    """Contributions that have what the tables and the receipts need: an id, a payer and an amount that is a number."""
    return contributions.where(missing().isNull())


def _metadata_row() -> list[Column]:
    return [
        F.col("contributionid"),
        F.col("created"),
        F.col("email"),
        F.col("country"),
        F.col("pageview_id"),
        F.col("browser_id"),
        F.col("allocations").alias("abtests"),
        F.col("cmp"),
        F.col("intcmp"),
        F.col("referrer_url").alias("referer_url"),
        F.col("referrer_pageview_id").alias("referer_pageview_id"),
        F.col("platform"),
    ]


def metadata_rows(contributions: DataFrame) -> DataFrame:
    return contributions.select(*_metadata_row(), *ARRIVAL)


def contribution_metadata(rows: DataFrame) -> DataFrame:
    """One row per contribution, the last to arrive. The visit id is not part of this table."""
    return folds.last_write(rows, "contributionid", ARRIVAL).select(*_METADATA)


def live_contributors(contributions: DataFrame) -> DataFrame:
    """One row per receipt email: newest non-null details, the very first contributor id, time of the last write."""
    merged = folds.merge_newest(
        contributions.withColumnRenamed("email", "receipt_email"), "receipt_email", ARRIVAL, NEWEST, OLDEST, "received_at"
    )
    return merged


def attribution_from_charges(hooks: DataFrame, metadata: str = "metadata", id_prefix: str = "") -> DataFrame:
    """Attribution that a charge carries as a map of texts, back as columns. Blanks and placeholders become null.

    ``id_prefix`` is what the analytics tool puts before page-view, browser and visit ids, as in the request readers.
    """
    m = F.from_json(F.col(metadata), "map<string,string>")
    text = lambda key: blank_to_null(F.col("_m")[key])
    known = lambda key, unknown: F.nullif(text(key), F.lit(unknown))
    return computed_once(hooks, {"_m": m}).select(
        *[c for c in hooks.columns if c != metadata],
        text("contributionId").alias("contributionid"),
        text("email").alias("email"),
        text("name").alias("name"),
        text("cmp").alias("cmp"),
        text("intcmp").alias("intcmp"),
        text(id_field(id_prefix, "PageviewId")).alias("pageview_id"),
        text(id_field(id_prefix, "BrowserId")).alias("browser_id"),
        text(id_field(id_prefix, "VisitId")).alias("visit_id"),
        text("refererPageviewId").alias("referer_pageview_id"),
        text("refererUrl").alias("referer_url"),
        known("countryCode", fixed.UNKNOWN_COUNTRY).alias("country_code"),
        known("countrySubdivisionCode", fixed.UNKNOWN_SUBDIVISION).alias("country_subdivision_code"),
        text("postcode").alias("postcode"),
        text("idUser").alias("iduser"),
        F.from_json(text("abTests"), ArrayType(ALLOCATION)).alias("abtests"),
    )


def edition(currency: Column) -> Column:
    return look_up(currency, fixed.EDITION, fixed.DEFAULT_EDITION)


def receipts(contributions: DataFrame, stored: Column, extension: str) -> DataFrame:
    """Receipt messages. Card receipts go out whatever happens to the tables, PayPal ones only once both are stored.

    Contributors of the listed campaigns get none; a contribution without a campaign does.
    """
    card = F.col("provider") == "Stripe"
    due = contributions.where(card | stored).where(
        ~F.coalesce(F.col("cmp").isin(*fixed.NO_RECEIPT_CAMPAIGNS), F.lit(False))
    )
    currency = F.when(card, F.upper("currency")).otherwise(F.col("currency"))
    subscriber = F.struct(
        F.col("email").alias("EmailAddress"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created"),
        F.col("amount").alias("amount"),
        currency.alias("currency"),
        edition(currency).alias("edition"),
        F.coalesce("name", F.lit("")).alias("name"),
    )
    to = F.struct(
        F.col("email").alias("Address"),
        F.col("email").alias("SubscriberKey"),
        F.struct(subscriber.alias("SubscriberAttributes")).alias("ContactAttributes"),
    )
    return due.select(F.col("paymentid"), to.alias("To"), F.lit(extension).alias("DataExtensionName"))


def receipt_payload(outbox: DataFrame) -> DataFrame:
    return outbox.select(F.to_json(F.struct("To", "DataExtensionName")).alias("payload"))


def consents(requests: DataFrame) -> DataFrame:
    """Consent messages, only for those who opted in."""
    return requests.where(F.col("opt_in")).select(
        "email", F.array(F.lit(fixed.CONSENT_ID)).alias("set-consents")
    )

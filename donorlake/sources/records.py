"""Provider records: PayPal payments, Stripe charges, identity users and the goal sheet.

These come from the providers' own interfaces, so they are read by schema and not rejected field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import schemas
from donorlake.functions import money
from donorlake.functions.stages import computed_once
from donorlake.functions.text import display_name, full_name, look_up
from donorlake.fixed_values import KNOWN_CURRENCIES
from donorlake.sources.kinds import read_by_kind


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def read_paypal_payments(raw: DataFrame, document: str = "document") -> DataFrame:
    """One row per payment; everything is taken from its first transaction."""
    p = F.from_json(F.col(document), schemas.PAYPAL_PAYMENT)
    with_payment = computed_once(raw, {"_p": p})
    transaction = first(F.col("_p.transactions"))
    payer = F.col("_p.payer.payer_info")
    billing, shipping = payer["billing_address"]["postal_code"], transaction["item_list"]["shipping_address"]["postal_code"]
    total = money.number(transaction["amount"]["total"])
    approval = first(F.filter(F.col("_p.links"), lambda link: F.lower(link["rel"]) == "approval_url"))
    return with_payment.select(
        *[c for c in raw.columns if c != document],
        F.col("_p.id").alias("paymentid"),
        F.upper("_p.state").alias("state"),
        F.try_to_timestamp(F.col("_p.create_time")).alias("created"),
        transaction.isNotNull().alias("has_transaction"),
        total.alias("total"),
        transaction["amount"]["currency"].alias("currency"),
        transaction["custom"].alias("custom"),
        first(transaction["related_resources"])["authorization"]["id"].alias("authorization_id"),
        payer.isNotNull().alias("has_payer"),
        payer["email"].alias("email"),
        payer["first_name"].alias("firstname"),
        payer["last_name"].alias("lastname"),
        full_name(payer["first_name"], payer["last_name"]).alias("name"),
        payer["country_code"].alias("country"),
        F.coalesce(billing, shipping).alias("postcode"),
        approval["href"].alias("approval_url"),
    )


def known_amount(total: Column, currency: Column) -> Column:
    """Amount text of a PayPal payment; null unless both the number and the currency are known."""
    code = look_up(currency, {c: c for c in KNOWN_CURRENCIES})
    return money.show_amount(total, code)


def approval(payments: DataFrame) -> DataFrame:
    """Where to send the payer: the first approval link, or an error if the link or the payment id is missing."""
    ok = F.col("approval_url").isNotNull() & F.col("paymentid").isNotNull()
    return payments.withColumn("approval_error", F.when(~ok, "Unable to parse payment"))


def read_stripe_charges(raw: DataFrame, document: str = "document") -> DataFrame:
    c = F.from_json(F.col(document), schemas.STRIPE_CHARGE)
    return computed_once(raw, {"_c": c}).select(
        *[name for name in raw.columns if name != document],
        F.col("_c.id").alias("paymentid"),
        money.from_minor(F.col("_c.amount")).alias("amount"),
        F.col("_c.currency").alias("currency"),
        F.timestamp_seconds("_c.created").alias("created"),
        F.col("_c.receipt_email").alias("email"),
        F.col("_c.balance_transaction").alias("balance_transaction"),
        F.col("_c.source.country").alias("country"),
    )


def read_payments(log: DataFrame) -> DataFrame:
    """Payment records of all payment sources from one log, by ``kind``: stripe, paypal-execute or paypal-capture."""
    readers = {"stripe": read_stripe_charges, "paypal-execute": read_paypal_payments, "paypal-capture": read_paypal_payments}
    return read_by_kind(log, readers)


def read_stripe_events(raw: DataFrame, document: str = "document") -> DataFrame:
    """Events by id: the charge they are about and the balance transaction it settled with, if any."""
    e = F.from_json(F.col(document), schemas.STRIPE_EVENT)
    return computed_once(raw, {"_e": e}).select(
        *[name for name in raw.columns if name != document],
        F.col("_e.id").alias("event_id"),
        F.col("_e.data.object.id").alias("charge_id"),
        F.col("_e.data.object.balance_transaction").alias("balance_transaction"),
    )


def read_balance_transactions(raw: DataFrame, document: str = "document") -> DataFrame:
    """Balance transactions by id: the amount they settled at, in minor units."""
    b = F.from_json(F.col(document), schemas.BALANCE_TRANSACTION)
    return computed_once(raw, {"_b": b}).select(
        *[name for name in raw.columns if name != document],
        F.col("_b.id").alias("balance_transaction"),
        F.col("_b.amount").alias("balance_minor"),
    )


def read_identity_users(raw: DataFrame, document: str = "document") -> DataFrame:
    u = F.from_json(F.col(document), schemas.IDENTITY_USER)
    private = F.col("_u.user.privateFields")
    return computed_once(raw, {"_u": u}).select(
        *[name for name in raw.columns if name != document],
        F.col("_u.user.primaryEmailAddress").alias("profile_email"),
        display_name(private["firstName"], private["secondName"]).alias("profile_name"),
    )


def read_goal_sheets(raw: DataFrame, document: str = "document") -> DataFrame:
    row = first(F.from_json(F.col(document), schemas.GOAL_SHEET)["sheets"]["Sheet1"])
    return computed_once(raw, {"_r": row}).select(
        *[name for name in raw.columns if name != document],
        F.col("_r.total").alias("sheet_total"),
        F.col("_r.goal").alias("goal"),
    )

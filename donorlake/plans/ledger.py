"""Payment ledger: webhook documents in, one row per contribution out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.functions import money
from donorlake.functions.text import uuid_text
from donorlake.operators import folds, lookups, running
from donorlake.schemas import PAYMENT_HOOKS

ARRIVAL = ("received_at", "delivery_id")
PARSED, PARSE_ERROR, INVALID, FAILED = "parsed", "parse-error", "invalid-request", "processing-error"
_COLUMNS = [f.name for f in PAYMENT_HOOKS.fields]


def triage(hooks: DataFrame, signed: Column | None = None) -> DataFrame:
    """Add ``outcome``. A document that does not parse is a parse error even if it is unsigned as well."""
    is_signed = F.lit(True) if signed is None else signed
    return hooks.withColumn(
        "outcome",
        F.when(F.col("problem").isNotNull(), PARSE_ERROR).when(~is_signed, INVALID).otherwise(PARSED),
    )


def parsed(hooks: DataFrame) -> DataFrame:
    return hooks.where(F.col("outcome") == PARSED)


def dead_letters(hooks: DataFrame, feed: str, document: str = "document") -> DataFrame:
    """Documents that were turned away, with the stage and the reason."""
    return hooks.where(F.col("outcome") != PARSED).select(
        F.col(document).alias("raw"),
        F.lit(feed).alias("feed"),
        F.coalesce("problem", F.lit("not signed")).alias("reason"),
        F.col("outcome").alias("stage"),
    )


def failures(hooks: DataFrame, feed: str, document: str = "document") -> DataFrame:
    """Documents that parsed but could not be processed, as dead letters."""
    return hooks.where(F.col("processing_error").isNotNull()).select(
        F.col(document).alias("raw"),
        F.lit(feed).alias("feed"),
        F.col("processing_error").alias("reason"),
        F.lit(FAILED).alias("stage"),
    )


def with_contribution_ids(hooks: DataFrame, payments: DataFrame) -> DataFrame:
    """PayPal hooks that carry no contribution id take it from the payment they belong to, if it has a good one.

    Only the hooks without an id need the look-up. The others get a null key, which the look-up spreads over all tasks.
    """
    known = payments.select("paymentid", F.col("custom").alias("_custom")).where(F.col("paymentid").isNotNull())
    wanted = F.when(F.col("contributionid").isNull(), F.col("paymentid"))
    found = lookups.look_up_left(hooks, known, wanted, "paymentid", F.col("delivery_id"))
    return (
        found.withColumn("contributionid", F.coalesce("contributionid", uuid_text(F.col("_custom"))))
        .withColumn("converted_minor", F.lit(None).cast("bigint"))
        .withColumn("processing_error", F.when(F.col("contributionid").isNull(), "Unable to find the paypal payment"))
        .drop("_custom")
    )


def with_converted_amounts(hooks: DataFrame, events: DataFrame, balances: DataFrame) -> DataFrame:
    """Stripe hooks with the event they announce and the amount it settled at.

    No event: an error, nothing is stored. No balance transaction: the converted amount is null.
    ``events`` has event_id and balance_transaction; ``balances`` has balance_transaction and balance_minor.
    """
    known = events.select(F.col("event_id").alias("_event"), "balance_transaction", F.lit(True).alias("_found"))
    by_event = lookups.look_up_left(hooks, known, F.col("event_id"), "_event", F.col("delivery_id"))
    settled = balances.select(F.col("balance_transaction").alias("_balance"), F.col("balance_minor").alias("converted_minor"))
    with_balance = lookups.look_up_left(
        by_event, settled, F.col("balance_transaction"), "_balance", F.col("delivery_id")
    )
    return with_balance.withColumn(
        "processing_error", F.when(F.col("_found").isNull(), "Unable to find the stripe event")
    ).drop("_found", "balance_transaction")


def ledger_rows(hooks: DataFrame) -> DataFrame:
    """Hooks that were processed, as ledger rows plus their arrival."""
    return hooks.where(F.col("processing_error").isNull()).select(
        *[F.col(c) for c in _COLUMNS if c != "convertedamount"],
        money.from_minor(F.col("converted_minor")).alias("convertedamount"),
        "mode",
        *ARRIVAL,
    )


def all_rows(paypal: DataFrame, stripe: DataFrame, mode: str = "Default") -> DataFrame:
    """Both feeds as one. The mode of a hook alone decides which ledger it belongs to."""
    both = ledger_rows(paypal).unionByName(ledger_rows(stripe))
    return both.where(F.col("mode") == mode)


def payment_hooks(rows: DataFrame) -> DataFrame:
    """The ledger: per contribution the last hook to arrive, whatever its own date says."""
    return folds.last_write(rows, "contributionid", ARRIVAL).select(*_COLUMNS)


def totals(ledger: DataFrame) -> DataFrame:
    """Contributions and amount by provider, currency, status and day."""
    return ledger.groupBy("provider", "currency", "status", F.to_date("created").alias("day")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("total")
    )


def paid_totals(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where(F.col("status") == "Paid")
        .groupBy("provider", "currency")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    )


def rollup(ledger: DataFrame) -> DataFrame:
    """Subtotals by provider, then currency, then status; ``level`` is the number of columns summed away."""
    cube = ledger.rollup("provider", "currency", "status").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total"), F.grouping_id().alias("_g")
    )
    return cube.withColumn("level", F.bit_count("_g").cast("int")).drop("_g")


def status_history(rows: DataFrame, chunk_rows: int = running.CHUNK_ROWS) -> DataFrame:
    """Every hook with the status before it, by arrival. ``is_regression`` marks a refund that was paid again.

    Rows are dealt in chunks of a number of rows, so a burst of hooks of one contribution is spread over tasks. They
    are read twice; give rows that are dear to make as a written table.
    """
    chunks = running.dealt(rows, "contributionid", ARRIVAL, chunk_rows)
    history = running.previous_row(chunks, "contributionid", ARRIVAL, ["status", "created"], F.col("_chunk"))
    back = (F.col("previous_status") == "Refunded") & (F.col("status") == "Paid")
    late = F.col("created") < F.col("previous_created")
    return history.withColumns(
        {"is_regression": F.coalesce(back, F.lit(False)), "is_late": F.coalesce(late, F.lit(False))}
    )


def outcome_report(hooks: DataFrame) -> DataFrame:
    """How many documents of each feed went which way, and why."""
    return hooks.groupBy("provider", "outcome", F.coalesce("problem", F.lit("none")).alias("reason")).agg(
        F.count("*").alias("n")
    )


def reconcile(ledger: DataFrame, metadata: DataFrame) -> DataFrame:
    """Ledger against attribution. The two are written apart, so either side can be missing."""
    left = ledger.select("contributionid", "amount", F.lit(True).alias("_paid"))
    right = metadata.select("contributionid", F.lit(True).alias("_attributed"))
    side = (
        F.when(F.col("_attributed").isNull(), "ledger only")
        .when(F.col("_paid").isNull(), "metadata only")
        .otherwise("both")
    )
    return (
        left.join(right, "contributionid", "full")
        .groupBy(side.alias("side"))
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    )


def revenue_by_campaign(ledger: DataFrame, metadata: DataFrame) -> DataFrame:
    """Paid revenue by campaign, country and platform."""
    keys = metadata.select("contributionid", "cmp", "country", "platform")
    paid = ledger.where(F.col("status") == "Paid").select("contributionid", "currency", "amount")
    return (
        paid.join(keys, "contributionid")
        .groupBy("cmp", "country", "platform", "currency")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    )

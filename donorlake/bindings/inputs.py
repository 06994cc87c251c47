"""Binding: the given tables as webhook documents, requests, payment records and beacons.

None of the given tables is about donations, so each input of a job is derived from whole tables by a fixed rule.
Raw documents are built as JSON text and go through the real readers. Some documents are damaged on purpose, by key.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions.text import uuid_text
from donorlake.operators import allocation
from donorlake.session import configure
from donorlake.sources import hits, records, requests, webhooks

CURRENCIES = ("GBP", "USD", "AUD", "EUR")
STRIPE_PRIORITIES = ("1-URGENT", "2-HIGH", "5-LOW")
EXECUTE_PRIORITY = "3-MEDIUM"
SOURCES = ("PartnerWeb", "PartnerApps", "Email")
ID_PREFIX = "site"
SALT = "0123456789abcdef"
FORM_FIELDS = ("name", "email", "amount", "postcode")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared expressions ------------------------------------------------------------------------------------------------


def every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def text_id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def uuid_of(key: str) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col(key).cast("string"), 12, "0"))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minor_text(minor: Column) -> Column:
    cents = F.lpad((minor % 100).cast("string"), 2, "0")
    return F.concat(F.floor(minor / 100).cast("bigint").cast("string"), F.lit("."), cents)


def currency_of(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (F.col(key) % 4 + 1).cast("int"))


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


# --- orders: webhook documents -------------------------------------------------------------------------------------


def payments_base(orders: DataFrame) -> DataFrame:
    stripe = F.col("o_orderpriority").isin(*STRIPE_PRIORITIES)
    received = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderstatus").alias("s"),
        F.floor("o_totalprice").cast("bigint").alias("minor"),
        received.alias("received_at"),
        F.col("o_orderkey").alias("delivery_id"),
        F.timestamp_seconds(F.unix_seconds(received) + F.col("o_orderkey") * 7 % 86400).alias("made_at"),
        F.when(stripe, "Stripe").otherwise("Paypal").alias("feed"),
        F.when(F.col("o_orderpriority") == EXECUTE_PRIORITY, "execute").otherwise("capture").alias("path"),
        currency_of("o_custkey").alias("cur"),
        (F.col("o_orderkey") % 79 != 0).alias("signature_ok"),
    )


def _damaged(document: Column) -> Column:
    return F.when(every("k", 83), F.concat(F.lit("not json "), F.col("k").cast("string"))).otherwise(document)


def _paypal_document() -> Column:
    kind = F.when(every("k", 3), "CAPTURE").otherwise("SALE")
    end = F.when(F.col("s") == "F", "DENIED").when(F.col("s") == "O", "COMPLETED").otherwise("REFUNDED")
    event = F.when(every("k", 89), "PAYMENT.SALE.PENDING").otherwise(F.concat_ws(".", F.lit("PAYMENT"), kind, end))
    custom = F.when(every("k", 73), "not-an-id").when(~every("k", 7), uuid_of("c"))
    document = F.to_json(
        F.struct(
            text_id("WH-", "k").alias("id"),
            event.alias("event_type"),
            F.struct(
                F.when(~every("k", 97), text_id("PAY-", "k")).alias("parent_payment"),
                custom.alias("custom"),
                iso(F.col("made_at")).alias("create_time"),
                F.struct(minor_text(F.col("minor")).alias("total"), F.col("cur").alias("currency")).alias("amount"),
            ).alias("resource"),
        )
    )
    bare_number = F.regexp_replace(document, '"total":"([0-9.]+)"', '"total":$1')
    return _damaged(F.when(every("k", 71), bare_number).otherwise(document))


def charge_metadata() -> Column:
    """The map of texts a charge carries, with blanks and placeholders as the checkout writes them."""
    return F.struct(
        uuid_of("c").alias("contributionId"),
        F.concat(F.lit("user"), F.col("c").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("Donor "), F.col("c").cast("string")).alias("name"),
        F.when(every("k", 4), "").otherwise(F.concat(F.lit("cmp_"), (F.col("c") % 50).cast("string"))).alias("cmp"),
        F.when(every("k", 5), "").otherwise(F.concat(F.lit("int_"), (F.col("k") % 9).cast("string"))).alias("intcmp"),
        text_id("pv", "k").alias(f"{ID_PREFIX}PageviewId"),
        F.when(every("k", 9), "").otherwise(text_id("bw", "c")).alias(f"{ID_PREFIX}BrowserId"),
        F.when(~every("k", 7), text_id("visit", "c")).alias(f"{ID_PREFIX}VisitId"),
        F.when(every("k", 6), "unknown-country-code").otherwise(
            F.concat(F.lit("c"), (F.col("c") % 25).cast("string"))
        ).alias("countryCode"),
        F.lit("unknown-country-subdivision-code").alias("countrySubdivisionCode"),
        F.when(every("k", 8), F.concat(F.lit("N"), F.col("k").cast("string"))).alias("postcode"),
        F.to_json(
            F.array(
                F.struct(
                    F.lit("Stripe checkout").alias("testName"),
                    F.lit("stripe-checkout").alias("testSlug"),
                    F.lit("stripe").alias("variantName"),
                    F.lit("stripe").alias("variantSlug"),
                )
            )
        ).alias("abTests"),
    )


def _stripe_document() -> Column:
    refunded = F.col("s") == "P"
    good = F.when((F.col("s") == "F") | (refunded & every("k", 5)), "failed").otherwise("succeeded")
    document = F.to_json(
        F.struct(
            text_id("evt_", "k").alias("id"),
            F.struct(
                F.struct(
                    text_id("ch_", "k").alias("id"),
                    (~every("k", 11)).alias("livemode"),
                    F.unix_seconds("made_at").alias("created"),
                    F.when(~every("k", 97), F.lower("cur")).alias("currency"),
                    F.col("minor").alias("amount"),
                    F.when(every("k", 89), "pending").otherwise(good).alias("status"),
                    refunded.alias("refunded"),
                    charge_metadata().alias("metadata"),
                ).alias("object")
            ).alias("data"),
        )
    )
    wrong_type = F.regexp_replace(document, '"email":"[^"]*"', '"email":5')
    return _damaged(F.when(every("k", 71), wrong_type).otherwise(document))


_ENVELOPE = ["document", "signature_ok", "received_at", "delivery_id", "k"]


def paypal_documents(orders: DataFrame) -> DataFrame:
    base = payments_base(orders).where(F.col("feed") == "Paypal")
    return base.withColumn("document", _paypal_document()).select(*_ENVELOPE)


def stripe_documents(orders: DataFrame) -> DataFrame:
    base = payments_base(orders).where(F.col("feed") == "Stripe")
    return base.withColumn("document", _stripe_document()).select(*_ENVELOPE)


def paypal_hooks(orders: DataFrame) -> DataFrame:
    return webhooks.read_paypal_hooks(paypal_documents(orders))


def stripe_hooks(orders: DataFrame) -> DataFrame:
    return webhooks.read_stripe_hooks(stripe_documents(orders))


def charge_maps(orders: DataFrame) -> DataFrame:
    base = payments_base(orders).where(F.col("feed") == "Stripe")
    return base.select(text_id("evt_", "k").alias("event_id"), F.to_json(charge_metadata()).alias("metadata"))


# --- orders and lineitem: provider records --------------------------------------------------------------------------


def stripe_events(orders: DataFrame) -> DataFrame:
    """Events of the provider; one in thirteen cannot be found, one in seventeen has no balance transaction."""
    charge = F.struct(text_id("ch_", "o_orderkey").alias("id"), F.when(~every("o_orderkey", 17), text_id("txn_", "o_orderkey")).alias("balance_transaction"))
    document = F.to_json(F.struct(text_id("evt_", "o_orderkey").alias("id"), F.struct(charge.alias("object")).alias("data")))
    return records.read_stripe_events(orders.where(~every("o_orderkey", 13)).select(document.alias("document")))


def balance_transactions(lineitem: DataFrame) -> DataFrame:
    settled = lineitem.groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice").cast("bigint")).alias("amount"))
    document = F.to_json(F.struct(text_id("txn_", "l_orderkey").alias("id"), "amount"))
    return records.read_balance_transactions(settled.select(document.alias("document")))


def _payment_document() -> Column:
    total = F.when(every("k", 37), "n/a").otherwise(minor_text(F.col("minor")))
    transaction = F.struct(
        F.struct(total.alias("total"), F.col("cur").alias("currency")).alias("amount"),
        uuid_of("c").alias("custom"),
        F.struct(F.struct(F.concat(F.lit("S"), F.col("c").cast("string")).alias("postal_code")).alias("shipping_address")).alias("item_list"),
    )
    payer = F.struct(
        F.concat(F.lit("user"), F.col("c").cast("string"), F.lit("@example.com")).alias("email"),
        F.when(~every("k", 3), F.concat(F.lit("First"), F.col("c").cast("string"))).alias("first_name"),
        F.when(~every("k", 5), F.concat(F.lit("Last"), F.col("k").cast("string"))).alias("last_name"),
        F.concat(F.lit("c"), (F.col("c") % 25).cast("string")).alias("country_code"),
        F.struct(F.when(every("k", 2), F.concat(F.lit("B"), F.col("k").cast("string"))).alias("postal_code")).alias("billing_address"),
    )
    links = F.array(
        F.struct(F.lit("self").alias("rel"), text_id("https://pay.example.com/", "k").alias("href")),
        F.struct(
            F.when(every("k", 19), "other").otherwise("Approval_Url").alias("rel"),
            text_id("https://pay.example.com/approve/", "k").alias("href"),
        ),
    )
    state = (
        F.when(every("k", 23), "failed").when(F.col("path") == "execute", "approved").otherwise("Completed")
    )
    return F.to_json(
        F.struct(
            text_id("PAY-", "k").alias("id"),
            state.alias("state"),
            iso(F.col("made_at")).alias("create_time"),
            F.when(~every("k", 41), F.struct(payer.alias("payer_info"))).alias("payer"),
            F.when(~every("k", 31), F.array(transaction)).otherwise(F.array().cast(F_TRANSACTIONS)).alias("transactions"),
            links.alias("links"),
        )
    )


F_TRANSACTIONS = (
    "array<struct<amount:struct<total:string,currency:string>,custom:string,"
    "item_list:struct<shipping_address:struct<postal_code:string>>>>"
)


def paypal_payments(orders: DataFrame) -> DataFrame:
    """Payment records of the provider."""
    base = payments_base(orders).where(F.col("feed") == "Paypal")
    raw = base.withColumn("document", _payment_document()).select(
        "document", "path", "received_at", "delivery_id", F.col("minor").alias("asked_minor")
    )
    return records.read_paypal_payments(raw)


def findable_payments(orders: DataFrame) -> DataFrame:
    """Payments that a look-up by id finds: one in forty-nine is gone."""
    return paypal_payments(orders).where(F.col("delivery_id") % 49 != 0)


def _charge_document() -> Column:
    return F.to_json(
        F.struct(
            text_id("ch_", "k").alias("id"),
            F.col("minor").alias("amount"),
            F.lower("cur").alias("currency"),
            F.unix_seconds("made_at").alias("created"),
            F.concat(F.lit("user"), F.col("c").cast("string"), F.lit("@example.com")).alias("receipt_email"),
            F.struct(F.concat(F.lit("c"), (F.col("c") % 25).cast("string")).alias("country")).alias("source"),
        )
    )


def payment_source() -> Column:
    return F.when(F.col("feed") == "Stripe", "stripe").otherwise(F.concat(F.lit("paypal-"), F.col("path")))


def payment_log(orders: DataFrame) -> DataFrame:
    """Payment records of both providers as documents; a card that was refused has no charge."""
    base = payments_base(orders).where((F.col("feed") != "Stripe") | (F.col("s") != "F"))
    document = F.when(F.col("feed") == "Stripe", _charge_document()).otherwise(_payment_document())
    return base.select(
        payment_source().alias("kind"), document.alias("document"), "received_at", "delivery_id",
        uuid_of("c").alias("given_id"), uuid_of("k").alias("contributor_id"),
    )


# --- events: requests ------------------------------------------------------------------------------------------------------


def request_base(events: DataFrame) -> DataFrame:
    k = props_k()
    suppressed = F.element_at(F.array(*[F.lit(c) for c in fixed.NO_RECEIPT_CAMPAIGNS]), (F.col("kk") % 4 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 100).cast("bigint").alias("value_minor"),
        k.alias("kk"),
    ).withColumns(
        {
            "cmp": F.when(every("kk", 10), None).when(F.col("kk") < 8, suppressed).otherwise(text_id("cmp_", "kk")),
            "intcmp": F.when(F.col("kk") % 3 == 0, None).otherwise(
                F.concat(F.lit("cmp_"), (F.col("kk") - F.col("kk") % 2).cast("string"))
            ),
            "test_id": (F.col("u") * 67 % 10000).cast("int"),
            "platform": F.when(every("id", 6), "android").when(every("id", 5), "ios"),
            "component_type": F.when(every("id", 4), "ACQUISITIONS_EPIC").when(every("id", 7), "ACQUISITIONS_THRASHER"),
            "source": F.when(every("id", 3), "PARTNER_WEB").when(every("id", 11), "partner_apps"),
            "referrer_test": F.when(every("id", 9), test_pair("banner", "blue")),
            "native_tests": F.when(
                ~every("id", 8), F.array(test_pair("stripe-checkout", "stripe"), test_pair("banner", "blue"))
            ),
            "is_support": F.when(every("id", 2), every("id", 4)),
        }
    )


def asked_requests(orders: DataFrame, events: DataFrame) -> DataFrame:
    """One request per order, ahead of its payment, of the kind that pays it, with what an event says of it.

    Events are dealt to orders in turn, so every order has its request. One order in 61 is asked for twice, as logs
    repeat themselves.
    """
    asked_at = F.timestamp_seconds(F.unix_seconds("received_at") - F.col("k") % 1800)
    made = payments_base(orders).select("k", payment_source().alias("kind_paid"), asked_at.alias("asked_at"))
    made = made.withColumn("_turn", F.pmod("k", F.lit(events.count())))
    said = request_base(events)
    log = made.join(said, made["_turn"] == said["id"]).drop("_turn")
    return log.withColumn("_again", F.explode(F.when(every("k", 61), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_again")


def request_log(orders: DataFrame, events: DataFrame) -> DataFrame:
    """The requests as documents of their kinds in one log."""
    kind = F.col("kind_paid")
    document = F.when(kind == "stripe", _card_form()).when(kind == "paypal-execute", _return_url()).otherwise(_capture_request())
    log = allocation.allocations(asked_requests(orders, events))
    back = kind == "paypal-execute"
    return log.select(
        kind.alias("kind"),
        document.alias("document"),
        "asked_at",
        F.when(kind == "stripe", text_id("ch_", "k")).alias("charge_id"),
        F.when(back, F.coalesce("platform", F.lit("web"))).alias("session_platform"),
        F.when(back & every("id", 2), F.col("u").cast("string")).alias("session_iduser"),
        "allocations",
    )


def read_requests(log: DataFrame, asked: Collection[str] | None = None) -> DataFrame:
    return requests.read_requests(log, id_prefix=ID_PREFIX, sources=SOURCES, asked=asked)


def test_pair(name: str, variant: str) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(variant).alias("variant"))


def _encoded(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), F.url_encode(value)))


def _card_form() -> Column:
    """A card checkout submission; it belongs to the charge of the same number."""
    return F.to_json(
        F.struct(
            F.concat(F.lit("Donor "), F.col("u").cast("string")).alias("name"),
            F.lower(currency_of("u")).alias("currency"),
            minor_text(F.col("value_minor")).alias("amount"),
            F.concat(F.lit("donor"), F.col("u").cast("string"), F.lit("@example.com")).alias("email"),
            F.when(~every("id", 101), text_id("tok_", "id")).alias("token"),
            F.when(every("id", 5), text_id("N", "id")).alias("postcode"),
            text_id("pv", "id").alias("sitePageviewId"),
            F.when(~every("id", 4), text_id("bw", "u")).alias("siteBrowserId"),
            "cmp",
            "intcmp",
            F.when(every("id", 3), text_id("rpv", "id")).alias("refererPageviewId"),
            F.when(every("id", 3), text_id("https://news.example.com/a?x=", "kk")).alias("refererUrl"),
            F.when(every("id", 2), F.col("u").cast("string")).alias("idUser"),
            "platform",
            text_id("visit", "u").alias("siteVisitId"),
            F.when(every("id", 4), "epic_1").alias("componentId"),
            F.col("component_type").alias("componentType"),
            "source",
            F.col("referrer_test").alias("refererAbTest"),
            F.col("native_tests").alias("nativeAbTests"),
            F.col("is_support").alias("isSupport"),
            F.lit("ignored").alias("unknownField"),
        )
    )


def _capture_request() -> Column:
    return F.to_json(
        F.struct(
            F.when(~every("id", 103), text_id("PAY-", "k")).alias("paymentId"),
            F.coalesce("platform", F.lit("ios")).alias("platform"),
            F.when(every("id", 2), F.col("u").cast("string")).alias("idUser"),
            "cmp",
            F.col("intcmp").alias("intCmp"),
            F.when(every("id", 3), text_id("rpv", "id")).alias("refererPageviewId"),
            F.when(every("id", 3), text_id("https://news.example.com/a?x=", "kk")).alias("refererUrl"),
            text_id("pv", "id").alias("sitePageviewId"),
            F.when(~every("id", 4), text_id("bw", "u")).alias("siteBrowserId"),
            F.when(every("id", 4), "epic_1").alias("componentId"),
            F.col("component_type").alias("componentType"),
            "source",
            test_pair("old", "unused").alias("abTest"),
            F.col("referrer_test").alias("refererAbTest"),
            F.col("native_tests").alias("nativeAbTests"),
        )
    )


def _return_url() -> Column:
    """Where the provider sends the payer back to."""
    query = F.concat_ws(
        "&",
        F.when(~every("id", 107), _encoded("paymentId", text_id("PAY-", "k"))),
        _encoded("token", text_id("EC-", "id")),
        _encoded("PayerID", text_id("payer", "u")),
        _encoded("CMP", F.col("cmp")),
        _encoded("INTCMP", F.col("intcmp")),
        _encoded("refererPageviewId", F.when(every("id", 3), text_id("rpv", "id"))),
        _encoded("refererUrl", F.when(every("id", 3), text_id("https://news.example.com/a?x=", "kk"))),
        _encoded("pvid", text_id("pv", "id")),
        _encoded("bid", F.when(~every("id", 4), text_id("bw", "u"))),
        _encoded("siteVisitId", text_id("visit", "u")),
        _encoded("componentId", F.when(every("id", 4), F.lit("epic_1"))),
        _encoded("componentType", F.col("component_type")),
        _encoded("source", F.col("source")),
        _encoded("refererAbTest", F.to_json("referrer_test")),
        _encoded("nativeAbTests", F.to_json("native_tests")),
        _encoded("supportRedirect", F.col("is_support").cast("string")),
    )
    return F.concat(F.lit("https://pay.example.com/paypal/uk/execute?"), query)


# --- contributions: payments joined with the requests that made them -------------------------------------------------


def stored() -> Column:
    """Whether both tables took the contribution; one in forty-three failed."""
    return F.col("delivery_id") % 43 != 0


def contributions(orders: DataFrame, log: DataFrame) -> DataFrame:
    """Payments of the orders with their requests in the log."""
    from donorlake.plans import attribution

    return attribution.contributions(records.read_payments(payment_log(orders)), read_requests(log))


_SHARED = [
    "paymentid", "contributionid", "contributor_id", "provider", "created", "email", "country", "amount", "currency",
    "name", "firstname", "lastname", "postcode", "iduser", "cmp", "intcmp", "referrer_url", "referrer_pageview_id",
    "pageview_id", "browser_id", "platform", "allocations", "received_at", "delivery_id",
]


def storable(contributions: DataFrame) -> DataFrame:
    """All contributions that were paid for and have what the tables need."""
    from donorlake.plans import attribution

    return attribution.storable(attribution.paid_for(contributions)).withColumn("amount", F.col("amount").cast("decimal(18,2)")).select(*_SHARED)


def all_contributions(orders: DataFrame, log: DataFrame) -> DataFrame:
    return storable(contributions(orders, log))


# --- ledger ----------------------------------------------------------------------------------------------------------------


def processed_hooks(
    orders: DataFrame, lineitem: DataFrame, records_: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(PayPal, Stripe) hooks that parsed, with what the providers know about them (``provider_records``)."""
    from donorlake.plans import ledger

    payments, events, balances = records_ or provider_records(orders, lineitem)
    paypal = ledger.parsed(ledger.triage(paypal_hooks(orders), F.col("signature_ok")))
    stripe = ledger.parsed(ledger.triage(stripe_hooks(orders)))
    return ledger.with_contribution_ids(paypal, payments), ledger.with_converted_amounts(stripe, events, balances)


def provider_records(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payments, events and balance transactions that look-ups by id find."""
    return findable_payments(orders).select("paymentid", "custom"), stripe_events(orders), balance_transactions(lineitem)


def rejected_hooks(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """All documents that end as dead letters: turned away, or not processed."""
    from donorlake.plans import ledger

    paypal = ledger.triage(paypal_hooks(orders), F.col("signature_ok"))
    stripe = ledger.triage(stripe_hooks(orders))
    failed_paypal, failed_stripe = processed_hooks(orders, lineitem)
    return (
        ledger.dead_letters(paypal, "paypal")
        .unionByName(ledger.dead_letters(stripe, "stripe"))
        .unionByName(ledger.failures(failed_paypal, "paypal"))
        .unionByName(ledger.failures(failed_stripe, "stripe"))
    )


def ledger_rows(orders: DataFrame, lineitem: DataFrame, records_: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    from donorlake.plans import ledger

    return ledger.all_rows(*processed_hooks(orders, lineitem, records_))


def ledger_table(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    from donorlake.plans import ledger

    return ledger.payment_hooks(ledger_rows(orders, lineitem))


# --- events: beacons, forms, metrics ---------------------------------------------------------------------------------------


def beacons(events: DataFrame) -> DataFrame:
    """Beacons: a page load is what a browser does on one day."""
    base = request_base(events)
    step = (
        F.when(F.col("kind") == "view", 1)
        .when(F.col("kind") == "click", 2)
        .when(F.col("kind") == "signup", 3)
        .when(F.col("kind") == "purchase", 4)
    )
    return base.select(
        F.col("id").alias("event_id"),
        "ts",
        F.concat_ws("-", F.col("u").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("pageview_id"),
        F.col("u").alias("browser_id"),
        "kind",
        "kk",
        step.alias("step"),
        F.element_at(F.array(F.lit("web"), F.lit("ios"), F.lit("android")), (F.col("u") % 3 + 1).cast("int")).alias("platform"),
        (F.col("u") % 10 == 3).alias("do_not_track"),
        (F.col("u") % 10 == 7).alias("analytics_off"),
        (F.col("value_minor").cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("price"),
        F.lower(currency_of("u")).alias("currency"),
    )


def hit_log(events: DataFrame) -> DataFrame:
    """Hits as a browser sends them: a view opens the checkout, a purchase is its last step, an error is an event.

    Some texts are no JSON, some are of a type that isn't known, some lack or spoil a field that their kind needs.
    """
    step, spoilt = F.col("step").isNotNull(), every("event_id", 97)
    sent = (
        F.when(F.col("kind") == "view", F.array(F.lit(hits.PAGE_VIEW), F.lit(hits.CHECKOUT)))
        .when(F.col("kind") == "purchase", F.array(F.lit(hits.CHECKOUT), F.lit(hits.PURCHASE)))
        .otherwise(F.array(F.when(step, hits.CHECKOUT).otherwise(hits.EVENT)))
    )
    rows = beacons(events).withColumn("sent", F.explode(sent))
    view, event, checkout, purchase = (F.col("sent") == k for k in (hits.PAGE_VIEW, hits.EVENT, hits.CHECKOUT, hits.PURCHASE))
    document = F.to_json(
        F.struct(
            F.when(every("event_id", 101), "timing").when(view, "pageview").otherwise("event").alias("hitType"),
            F.col("pageview_id").alias("pageviewId"),
            F.col("browser_id").cast("string").alias("clientId"),
            F.when(checkout, "Checkout").when(purchase, "Payment").when(event, "Form").alias("eventCategory"),
            F.when(purchase, "Contribute").when(checkout | (event & ~spoilt), F.col("kind")).alias("eventAction"),
            F.when(purchase, "purchase").alias("eventLabel"),
            F.when(event, F.col("kk")).alias("eventValue"),
            F.when(checkout | purchase, F.col("sent")).alias("productAction"),
            F.when(checkout, F.when(spoilt, F.lit(9)).otherwise(F.col("step"))).alias("step"),
            F.when(purchase & ~spoilt, F.col("price")).alias("revenue"),
            F.when(purchase, F.col("currency")).alias("currency"),
        )
    )
    no_json = F.concat(F.lit("not json "), F.col("event_id").cast("string"))
    return rows.select(
        "event_id", "ts", "platform", "do_not_track", "analytics_off", F.when(every("event_id", 89), no_json).otherwise(document).alias("document")
    )


def read_hits(events: DataFrame) -> DataFrame:
    return hits.read_hits(hit_log(events))


def checkout_beacons(events: DataFrame) -> DataFrame:
    from donorlake.plans.beacons import with_consent

    return with_consent(read_hits(events)).where(F.col("kind") == hits.CHECKOUT)


def purchase_beacons(events: DataFrame) -> DataFrame:
    return read_hits(events).where(F.col("kind") == hits.PURCHASE)


def _form_state(df: DataFrame) -> DataFrame:
    """Errors and empty fields are bits of k."""
    bit = lambda i: F.expr(f"kk div {2 ** i} % 2 = 1")
    names = lambda offset: F.array_compact(
        F.array(*[F.when(bit(i + offset), F.lit(f)) for i, f in enumerate(FORM_FIELDS)])
    )
    return df.withColumns(
        {
            "form_action": F.when(F.col("browser_id") % 2 == 0, "/pay").otherwise("/register"),
            "errors": names(0),
            "empties": names(2),
        }
    )


def form_opens(events: DataFrame) -> DataFrame:
    return _form_state(beacons(events).where(F.col("kind").isin("view", "error")))


def form_submits(events: DataFrame) -> DataFrame:
    return _form_state(beacons(events).where(F.col("kind").isin("click", "purchase")))


def form_beacons(events: DataFrame) -> DataFrame:
    """Opens and submits as one stream."""
    kinds = F.col("kind").isin("view", "error", "click", "purchase")
    return _form_state(beacons(events).where(kinds)).withColumn("is_submit", F.col("kind").isin("click", "purchase"))


def metric_events(events: DataFrame) -> DataFrame:
    b = beacons(events)
    authorisation, other = F.col("kk") % 4 == 1, F.col("kk") % 9 == 2
    kind = lambda k, *more: (F.col("kind") == k) & (more[0] if more else F.lit(True))
    name = (
        F.when(kind("view", F.col("kk") % 7 == 0), "post-payment-page-displayed")
        .when(kind("view"), "home-page-displayed")
        .when(kind("click", authorisation), "payment-authorisation-attempt")
        .when(kind("click"), "payment-attempt")
        .when(kind("purchase", authorisation), "payment-authorisation-success")
        .when(kind("purchase", other), "payment-success-redirected-to-other-platform")
        .when(kind("purchase"), "payment-success")
        .when(kind("error", authorisation), "payment-authorisation-failure")
        .when(kind("error", other), "unhandled-payment-failure")
        .when(kind("error"), "payment-failure")
        .otherwise("thank-you-page-displayed")
    )
    from donorlake.plans.counters import provider_dimension

    provider = F.when(F.col("kk") < 40, "Stripe").when(F.col("kk") < 80, "Paypal")
    dimension = F.when(F.col("kind") == "view", "na").otherwise(provider_dimension(provider))
    return b.select("ts", name.alias("name"), dimension.alias("payment_provider"), "platform")


def triaged_hooks(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Every hook of both feeds with its outcome and, if it parsed, its processing error."""
    from donorlake.plans import ledger

    wanted = ["provider", "outcome", "problem", "processing_error", "received_at", "platform"]
    paypal = ledger.triage(paypal_hooks(orders), F.col("signature_ok"))
    stripe = ledger.triage(stripe_hooks(orders))
    done_paypal = ledger.with_contribution_ids(paypal, findable_payments(orders))
    done_stripe = ledger.with_converted_amounts(stripe, stripe_events(orders), balance_transactions(lineitem))
    frames = [d.withColumn("platform", F.lit("web")).select(*wanted) for d in (done_paypal, done_stripe)]
    return frames[0].unionByName(frames[1])

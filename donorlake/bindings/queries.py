"""The queries: every job over whole given tables, with its result in plain types (text, number, boolean)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from donorlake.bindings import inputs
from donorlake.bindings.inputs import every, props_k, table, text_id, uuid_of
from donorlake.functions import money
from donorlake.functions import text as text_rules
from donorlake.functions.text import full_name
from donorlake.operators import allocation, running, sticky
from donorlake.plans import acquisitions, attribution, beacons, counters, experiments, forms, ledger, visitors
from donorlake.session import written
from donorlake.sources import hits, records, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- plain types --------------------------------------------------------------------------------------------------------


def dbl(name: str | Column, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return column.cast("double").alias(alias or name)


def text_time(name: str, alias: str | None = None) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def joined(name: str | Column, alias: str) -> Column:
    return F.array_join(name, ",").alias(alias)


def tests_text(name: str, alias: str) -> Column:
    pairs = F.array_sort(F.transform(F.col(name), lambda t: F.concat_ws(":", t["name"], t["variant"])))
    return joined(pairs, alias)


def allocs_text(name: str, alias: str) -> Column:
    pairs = F.array_sort(F.transform(F.col(name), lambda t: F.concat_ws(":", t["testSlug"], t["variantSlug"])))
    return joined(pairs, alias)


# --- webhooks and ledger ------------------------------------------------------------------------------------------------


def _hook_columns(hooks: DataFrame) -> DataFrame:
    return hooks.select(
        "delivery_id", "contributionid", "paymentid", text_time("created"), "currency", dbl("amount"), "status",
        "email", "mode",
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.request_log(table(spark, sf, "orders"), table(spark, sf, "events"))


@query
def hooks_normalise_paypal(spark: SparkSession, sf: str) -> DataFrame:
    hooks = ledger.triage(inputs.paypal_hooks(table(spark, sf, "orders")), F.col("signature_ok"))
    return _hook_columns(ledger.parsed(hooks))


@query
def hooks_normalise_stripe(spark: SparkSession, sf: str) -> DataFrame:
    return _hook_columns(ledger.parsed(ledger.triage(inputs.stripe_hooks(table(spark, sf, "orders")))))


@query
def hooks_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    paypal = ledger.triage(inputs.paypal_hooks(orders), F.col("signature_ok"))
    stripe = ledger.triage(inputs.stripe_hooks(orders))
    keep = ["provider", "outcome", "problem"]
    return ledger.outcome_report(paypal.select(*keep).unionByName(stripe.select(*keep)))


@query
def hooks_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    paypal = ledger.triage(inputs.paypal_hooks(orders), F.col("signature_ok"))
    stripe = ledger.triage(inputs.stripe_hooks(orders))
    dead = ledger.dead_letters(paypal, "paypal").unionByName(ledger.dead_letters(stripe, "stripe"))
    return dead.groupBy("feed", "reason", "stage").agg(F.count("*").alias("n"))


@query
def payment_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.ledger_table(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    return rows.select(
        "contributionid", "paymentid", "provider", text_time("created"), "currency", dbl("amount"),
        dbl("convertedamount"), "status", "email",
    )


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.ledger_table(table(spark, sf, "orders"), table(spark, sf, "lineitem"))


@query
def ledger_paid_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.paid_totals(_ledger(spark, sf)).select("provider", "currency", "n", dbl("total"))


@query
def ledger_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.totals(_ledger(spark, sf)).select(
        "provider", "currency", "status", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", dbl("total")
    )


@query
def ledger_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.rollup(_ledger(spark, sf)).select("provider", "currency", "status", "level", "n", dbl("total"))


@query
def ledger_regressions(spark: SparkSession, sf: str) -> DataFrame:
    # The history looks at its rows twice, and documents are to be read once.
    rows = written(inputs.ledger_rows(table(spark, sf, "orders"), table(spark, sf, "lineitem")), "history")
    return ledger.status_history(rows).select(
        "delivery_id", "contributionid", "status", "previous_status", "is_regression", "is_late"
    )


@query
def converted_amount(spark: SparkSession, sf: str) -> DataFrame:
    _, stripe = inputs.processed_hooks(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    return ledger.ledger_rows(stripe).select(
        "delivery_id", "contributionid", "paymentid", dbl("amount"), dbl("convertedamount"), "status", "mode"
    )


@query
def hooks_without_event(spark: SparkSession, sf: str) -> DataFrame:
    _, stripe = inputs.processed_hooks(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    return stripe.where(F.col("processing_error").isNotNull()).select("delivery_id", "event_id", "processing_error")


@query
def paypal_id_backfill(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    hooks = ledger.parsed(ledger.triage(inputs.paypal_hooks(orders), F.col("signature_ok")))
    filled = ledger.with_contribution_ids(
        hooks.withColumn("had_id", F.col("contributionid").isNotNull()), inputs.findable_payments(orders)
    )
    return filled.select("delivery_id", "paymentid", "had_id", "contributionid", "processing_error")


# --- attribution --------------------------------------------------------------------------------------------------------


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    everything = inputs.all_contributions(table(spark, sf, "orders"), request_log(spark, sf))
    return attribution.contribution_metadata(attribution.metadata_rows(everything.where(inputs.stored())))


def metadata_columns(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        "contributionid", text_time("created"), "email", "country", "pageview_id", "browser_id",
        allocs_text("abtests", "abtests"), "cmp", "intcmp", "referer_url", "referer_pageview_id", "platform",
    )


@query
def metadata_table(spark: SparkSession, sf: str) -> DataFrame:
    return metadata_columns(_metadata(spark, sf))


@query
def contribution_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """What every payment and every request came to; both sides add up to their logs."""
    # Both sides of the accounts look at both logs, and documents are to be made and read once. Their text is not told of.
    payments = written(records.read_payments(inputs.payment_log(table(spark, sf, "orders"))).drop("document"), "payments")
    asked = written(inputs.read_requests(request_log(spark, sf)).drop("document"), "requests")
    return attribution.accounts(attribution.contributions(payments, asked), payments, asked, inputs.stored())


def raw_keys(dead: DataFrame) -> DataFrame:
    """Dead letters with the ids that their text holds."""
    said = lambda path: F.get_json_object("raw", path)
    url = F.col("raw").startswith("https:")
    page = F.when(url, F.try_parse_url("raw", F.lit("QUERY"), F.lit("pvid"))).otherwise(said(f"$.{inputs.ID_PREFIX}PageviewId"))
    return dead.select("feed", "stage", "reason", F.when(~url, said("$.id")).alias("raw_id"), page.alias("raw_pageview_id"))


@query
def contribution_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected requests and payments that reached no table, with their text."""
    asked = inputs.read_requests(request_log(spark, sf))
    payments = records.read_payments(inputs.payment_log(table(spark, sf, "orders")))
    return raw_keys(attribution.dead_letters(attribution.contributions(payments, asked), asked, inputs.stored()))


@query
def attribution_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = attribution.attribution_from_charges(inputs.charge_maps(table(spark, sf, "orders")), id_prefix=inputs.ID_PREFIX)
    return rows.select(
        "event_id", "contributionid", "email", "name", "cmp", "intcmp", "country_code", "country_subdivision_code",
        "postcode", "pageview_id", "browser_id", "visit_id", allocs_text("abtests", "abtests"),
    )


def saved_contributors(orders: DataFrame, customer: DataFrame) -> DataFrame:
    base = inputs.payments_base(orders).join(customer, F.col("c") == F.col("c_custkey"))
    first = F.when(~every("k", 3), F.col("c_name"))
    last = F.when(~every("k", 5), F.concat(F.lit("of "), F.initcap("c_mktsegment")))
    return base.select(
        F.concat(F.lit("user"), F.col("c").cast("string"), F.lit("@example.com")).alias("email"),
        full_name(first, last).alias("name"),
        first.alias("firstname"),
        last.alias("lastname"),
        F.when(every("k", 4), F.col("c").cast("string")).alias("iduser"),
        F.when(every("k", 5), text_id("N", "k")).alias("postcode"),
        F.when(~every("k", 11), uuid_of("k")).alias("contributor_id"),
        "received_at",
        "delivery_id",
    )


def contributor_columns(table_: DataFrame) -> DataFrame:
    return table_.select(
        "receipt_email", "name", "firstname", "lastname", "iduser", "postcode", "contributor_id", text_time("updated")
    )


@query
def contributors_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = saved_contributors(table(spark, sf, "orders"), table(spark, sf, "customer"))
    return contributor_columns(attribution.live_contributors(rows))


@query
def ledger_metadata_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.reconcile(_ledger(spark, sf), _metadata(spark, sf)).select("side", "n", dbl("total"))


@query
def revenue_by_campaign(spark: SparkSession, sf: str) -> DataFrame:
    report = ledger.revenue_by_campaign(_ledger(spark, sf), _metadata(spark, sf))
    return report.select("cmp", "country", "platform", "currency", "n", dbl("total"))


@query
def revenue_by_variant(spark: SparkSession, sf: str) -> DataFrame:
    paid = _ledger(spark, sf).where(F.col("status") == "Paid").select("contributionid", "currency", "amount")
    tested = _metadata(spark, sf).select("contributionid", F.explode("abtests").alias("t"))
    return (
        paid.join(tested, "contributionid")
        .groupBy(F.col("t.testSlug").alias("test"), F.col("t.variantSlug").alias("variant"), "currency")
        .agg(F.count("*").alias("n"), dbl(F.sum("amount"), "total"))
    )


@query
def receipts_outbox(spark: SparkSession, sf: str) -> DataFrame:
    everything = inputs.all_contributions(table(spark, sf, "orders"), request_log(spark, sf))
    out = attribution.receipts(everything, inputs.stored(), "contribution-thank-you")
    attributes = "To.ContactAttributes.SubscriberAttributes"
    return out.select(
        "paymentid",
        F.col("To.Address").alias("address"),
        F.col("To.SubscriberKey").alias("subscriber_key"),
        F.col(f"{attributes}.created").alias("created"),
        dbl(F.col(f"{attributes}.amount"), "amount"),
        F.col(f"{attributes}.currency").alias("currency"),
        F.col(f"{attributes}.edition").alias("edition"),
        F.col(f"{attributes}.name").alias("name"),
        F.col("DataExtensionName").alias("extension"),
    )


def opt_ins(events: DataFrame) -> DataFrame:
    return inputs.request_base(events).select(
        F.concat(F.lit("donor"), F.col("u").cast("string"), F.lit("@example.com")).alias("email"),
        (F.col("kk") >= 50).alias("opt_in"),
    )


@query
def consent_outbox(spark: SparkSession, sf: str) -> DataFrame:
    sent = attribution.consents(opt_ins(table(spark, sf, "events")))
    return sent.groupBy("email", joined("set-consents", "consents")).agg(F.count("*").alias("n"))


# --- acquisitions ---------------------------------------------------------------------------------------------------------


def _acquisition_feed(spark: SparkSession, sf: str) -> DataFrame:
    # Each source has its own builder, and the logs are to be read once.
    paid = attribution.paid_for(inputs.contributions(table(spark, sf, "orders"), request_log(spark, sf)))
    return acquisitions.build_by_kind(written(paid, "contributions"))


@query
def acquisition_events(spark: SparkSession, sf: str) -> DataFrame:
    return acquisitions.events(_acquisition_feed(spark, sf)).select(
        "paymentid", "payment_source", "product", "payment_frequency", "currency", "amount", "payment_provider",
        joined("campaign_codes", "campaign_codes"), tests_text("ab_tests", "ab_tests"), "country_code",
        "referrer_pageview_id", "referrer_url", "component_id", "component_type", "source", "platform",
        "pageview_id", "visit_id", "browser_id",
    )


@query
def acquisition_messages(spark: SparkSession, sf: str) -> DataFrame:
    """What the outbound text says of component and source, as it spells them."""
    sent = acquisitions.messages(acquisitions.events(_acquisition_feed(spark, sf)))
    said = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    return sent.select("paymentid", *map(said, ("component_type", "source", "payment_frequency", "platform")))


@query
def acquisition_errors(spark: SparkSession, sf: str) -> DataFrame:
    return acquisitions.errors(_acquisition_feed(spark, sf))


@query
def paypal_approvals(spark: SparkSession, sf: str) -> DataFrame:
    approved = records.approval(inputs.paypal_payments(table(spark, sf, "orders")))
    return approved.select(
        "paymentid", "approval_url", "approval_error", records.known_amount(F.col("total"), F.col("currency")).alias("shown"),
        visitors.state_accepted(F.col("state"), F.col("path")).alias("accepted"),
    )


@query
def paypal_error_report(spark: SparkSession, sf: str) -> DataFrame:
    failed = inputs.request_base(table(spark, sf, "events")).where(F.col("kind") == "error")
    names = F.array(*[F.lit(n) for n in ("INVALID_RESOURCE_ID", "PAYMENT_ALREADY_DONE", "INSTRUMENT_DECLINED", "RATE_LIMIT")])
    errors = failed.select(
        F.element_at(names, (F.col("kk") % 4 + 1).cast("int")).alias("error_name"),
        F.when(F.col("kk") % 6 == 0, "").when(F.col("kk") % 6 != 5, "payment failed").alias("error_message"),
    )
    return counters.payment_errors(errors)


@query
def auth_requests(spark: SparkSession, sf: str) -> DataFrame:
    base = inputs.request_base(table(spark, sf, "events"))
    group = F.element_at(F.array(*[F.lit(g) for g in ("uk", "us", "au", "eu", "mars")]), (F.col("kk") % 5 + 1).cast("int"))
    document = F.to_json(
        F.struct(
            group.alias("countryGroup"),
            (F.col("value_minor").cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("amount"),
            "cmp",
            F.col("intcmp").alias("intCmp"),
            F.concat(F.lit("https://news.example.com/a?x="), F.col("kk").cast("string"), F.lit("#part")).alias("refererUrl"),
            F.col("is_support").alias("supportRedirect"),
            F.col("component_type").alias("componentType"),
        )
    )
    parsed = requests.read_auth_requests(base.select("id", document.alias("document")), sources=inputs.SOURCES)
    return parsed.select(
        "id", "problem", "country_group", dbl("amount"), "cmp", "intcmp", "referrer_url", "component_type", "is_support"
    )


# --- amounts and submissions ------------------------------------------------------------------------------------------


def _amount_requests(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    thousandths = F.floor("o_totalprice").cast("bigint") * 7
    code = F.when(every("o_custkey", 29), "XXX").otherwise(F.lower(inputs.currency_of("o_custkey")))
    return orders.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderpriority").alias("priority"),
        (thousandths.cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,3)").alias("amount"),
        code.alias("currency"),
    )


@query
def amount_caps(spark: SparkSession, sf: str) -> DataFrame:
    return visitors.amount_caps(_amount_requests(spark, sf)).select(
        "request_id", "known_currency", "paypal_accepted", dbl("paypal_amount"), "stripe_minor", "card_group"
    )


@query
def submission_quality(spark: SparkSession, sf: str) -> DataFrame:
    asked = _amount_requests(spark, sf)
    entered = F.when(F.col("priority") != "5-LOW", F.col("amount"))
    entered = F.when(F.col("priority") == "2-HIGH", entered / 1000).otherwise(entered)
    selected = F.when(every("c", 2), F.lit(50))
    rule = forms.amount_rule(entered, selected, money.known_currency(F.col("currency")))
    return asked.groupBy("priority", rule.alias("rule")).agg(F.count("*").alias("n"))


@query
def preset_vs_custom(spark: SparkSession, sf: str) -> DataFrame:
    asked = _amount_requests(spark, sf)
    group = F.when(F.col("c") % 3 == 0, "au").when(F.col("c") % 3 == 1, "uk")
    choices = F.array(*[F.lit(v) for v in (25, 50, 100, 250, 500)])
    picked = F.element_at(choices, (F.col("c") % 5 + 1).cast("int")).cast("decimal(18,2)")
    amount = F.when(F.col("priority") == "5-LOW", F.col("amount").cast("decimal(18,2)")).otherwise(picked)
    override = F.when(every("c", 10), F.array(F.lit(3), F.lit(25), F.lit(700)))
    shown = money.show_amount(amount, F.lit("GBP"))
    return asked.select(
        F.coalesce(group, F.lit("none")).alias("country_group"),
        override.isNotNull().alias("in_amount_test"),
        forms.is_preset(money.amount_part(shown), group, override).alias("is_preset"),
    ).groupBy("country_group", "in_amount_test", "is_preset").agg(F.count("*").alias("n"))


FIELD_RULES = forms.rules_from_rows(
    [
        {"rule_id": "text_required", "column": "text", "required": True},
        {"rule_id": "text_length", "column": "text", "min_length": 200, "max_length": 4000},
        {"rule_id": "source_pattern", "column": "source", "pattern": "^src[0-9]$"},
        {"rule_id": "quality_required", "column": "quality", "required": True},
        {"rule_id": "language_profile", "column": "lang", "profile": "lang in ('en', 'fr')"},
        {"rule_id": "disabled_rule", "column": "text", "max_length": 1, "disabled": True},
        {"rule_id": "trimmed_text", "column": "text", "profile": "n_chars >= length(trim(text))"},
    ]
)


@query
def field_rules_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return forms.rule_report(rows, FIELD_RULES, by=["lang"])


@query
def mode_split(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "supplier").select(F.col("s_name").alias("user_name"))
    payments = inputs.payments_base(table(spark, sf, "orders")).select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("c").cast("string"), 9, "0"), F.lit(" Smith")).alias("name"),
        money.from_minor(F.col("minor")).alias("amount"),
    )
    return visitors.mode_report(payments, users).select("mode", "n", dbl("total"))


@query
def request_modes(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "supplier").select(F.col("s_name").alias("user_name"))
    named = lambda key: F.concat(F.lit("Supplier#"), F.lpad(F.col(key).cast("string"), 9, "0"))
    requests_ = inputs.request_base(table(spark, sf, "events")).select(
        F.when(every("id", 5), named("kk")).alias("query_name"),
        F.when(every("id", 3), named("id")).alias("cookie_name"),
        F.when(~every("id", 7), named("u")).alias("profile_name"),
    )
    return visitors.request_mode_report(requests_, "query_name", "cookie_name", "profile_name", users)


@query
def text_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as a form field might hand them in, with blanks, tabs and line ends around them."""
    entered = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\r\n "))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(text_rules.trim_whitespace(entered)).cast("bigint").alias("trimmed"),
        F.length(text_rules.remove_whitespace(entered)).cast("bigint").alias("solid"),
    )


# --- experiments -----------------------------------------------------------------------------------------------------------

TESTS = (
    *allocation.EXPERIMENTS,
    allocation.Experiment("Half & half", 50, 25, ("control", "Variant B")),
    allocation.Experiment("Three ways", 33.3, 0, ("a", "b", "c"), "kk >= 20"),
)


def _visitors(spark: SparkSession, sf: str) -> DataFrame:
    base = inputs.request_base(table(spark, sf, "events"))
    campaign = (
        F.when(F.col("kk") % 5 == 0, "spring_ge2017_interactive_slice_2")
        .when(F.col("kk") % 5 == 1, "other_thrasher_x")
        .when(F.col("kk") % 5 == 2, "own_thrasher")
        .when(F.col("kk") % 5 == 3, "unrelated")
    )
    asked = (
        F.when(F.col("kk") == 1, "Half & half=variant-b")
        .when(F.col("kk") == 2, "THREE-WAYS=A=ignored")
        .when(F.col("kk") == 3, "three-ways=")
        .when(F.col("kk") == 4, "nothing=control")
    )
    return base.withColumn("intcmp", campaign).withColumn("ab", asked)


@query
def ab_allocation(spark: SparkSession, sf: str) -> DataFrame:
    found = allocation.allocations(_visitors(spark, sf), experiments=TESTS)
    return experiments.allocation_rows(found, "id", "test_id")


@query
def ab_forced(spark: SparkSession, sf: str) -> DataFrame:
    found = allocation.allocations(_visitors(spark, sf), parameter="ab", experiments=TESTS)
    return found.select("id", "ab", allocs_text("allocations", "allocations"), F.size("allocations").alias("n"))


@query
def ab_registration(spark: SparkSession, sf: str) -> DataFrame:
    found = allocation.allocations(_visitors(spark, sf), parameter="ab", experiments=TESTS)
    each = F.explode(allocation.registration(F.col("allocations"), False)).alias("test", "entry")
    return (
        found.select(each)
        .groupBy("test", F.col("entry.variantName").alias("variant"), F.col("entry.complete").alias("complete"))
        .agg(F.count("*").alias("n"))
    )


@query
def ab_exposure(spark: SparkSession, sf: str) -> DataFrame:
    found = allocation.allocations(_visitors(spark, sf), parameter="ab", experiments=TESTS)
    return experiments.exposure(found.withColumn("paid", F.col("kind") == "purchase"), "u", "paid")


@query
def ab_exposure_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure from daily sketches next to the exact one: whether it is within five hundredths, over all days."""
    found = allocation.allocations(_visitors(spark, sf), parameter="ab", experiments=TESTS)
    days = written(experiments.daily_sketches(found, "u", "ts"), "sketches")
    sketched = experiments.exposure_of_sketches(days).withColumnRenamed("visitors", "sketched")
    exact = experiments.exposure(found.withColumn("paid", F.lit(False)), "u", "paid")
    near = F.abs(F.col("sketched") - F.col("visitors")) <= F.greatest(0.05 * F.col("visitors"), F.lit(1))
    return exact.join(sketched, ["testSlug", "variantName"]).select("testSlug", "variantName", "visitors", near.alias("near"))


@query
def ab_sticky_id(spark: SparkSession, sf: str) -> DataFrame:
    requests_ = table(spark, sf, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    return sticky.assignments(requests_, "user_id", "ts")


@query
def preset_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly buttons and the one that is pressed at first, by country group."""
    asked = _amount_requests(spark, sf)
    group = F.when(F.col("c") % 3 == 0, "au").when(F.col("c") % 3 == 1, "uk")
    choices = F.array(*[F.lit(v) for v in (2, 5, 10, 20, 25, 50, 100)])
    picked = F.element_at(choices, (F.col("c") % 7 + 1).cast("int")).cast("decimal(18,2)")
    none = F.lit(None).cast("array<int>")
    return asked.select(
        F.coalesce(group, F.lit("none")).alias("country_group"),
        forms.preselected_amount(group, F.when(every("c", 10), 25)).alias("preselected"),
        forms.is_preset(picked, group, none, monthly=True).alias("is_preset"),
    ).groupBy("country_group", "preselected", "is_preset").agg(F.count("*").alias("n"))


# --- counters ---------------------------------------------------------------------------------------------------------------


@query
def metric_counts(spark: SparkSession, sf: str) -> DataFrame:
    report = counters.counts(inputs.metric_events(table(spark, sf, "events")), "1 hour")
    return report.select(text_time("window_start"), "name", "payment_provider", "platform", "n")


@query
def metric_rates(spark: SparkSession, sf: str) -> DataFrame:
    hooks = inputs.triaged_hooks(table(spark, sf, "orders"), table(spark, sf, "lineitem"))
    both = counters.hook_metrics(hooks).unionByName(inputs.metric_events(table(spark, sf, "events")))
    return counters.rates(both)


# --- beacons and forms ------------------------------------------------------------------------------------------------------


@query
def beacon_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every hit is of one kind or was turned away for one reason."""
    return inputs.read_hits(table(spark, sf, "events")).groupBy("kind", "problem").agg(F.count("*").alias("n"))


@query
def beacon_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that were turned away, each with its text."""
    return hits.rejected(inputs.read_hits(table(spark, sf, "events")))


@query
def checkout_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return beacons.funnel(inputs.checkout_beacons(table(spark, sf, "events")))


@query
def checkout_first_steps(spark: SparkSession, sf: str) -> DataFrame:
    first = beacons.first_steps(inputs.checkout_beacons(table(spark, sf, "events")))
    return first.select("pageview_id", "step", "event_id")


@query
def form_errors(spark: SparkSession, sf: str) -> DataFrame:
    return forms.event_report(forms.submit_events(inputs.form_submits(table(spark, sf, "events"))))


def _abandoned(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return forms.abandonment_events(forms.abandoned(inputs.form_opens(events), inputs.form_submits(events)))


@query
def form_abandonment(spark: SparkSession, sf: str) -> DataFrame:
    return forms.event_report(_abandoned(spark, sf))


@query
def top_form_errors(spark: SparkSession, sf: str) -> DataFrame:
    submitted = forms.submit_events(inputs.form_submits(table(spark, sf, "events")))
    both = submitted.unionByName(_abandoned(spark, sf))
    return forms.top_labels(both, ["submit:error", "abandoned:empty"], 5)


def _purchases(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.purchase_beacons(table(spark, sf, "events"))


@query
def beacon_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return beacons.revenue(_purchases(spark, sf)).select("currency", "n", dbl("total"))


@query
def beacon_vs_ledger(spark: SparkSession, sf: str) -> DataFrame:
    gap = beacons.revenue_gap(_purchases(spark, sf), _ledger(spark, sf))
    return gap.select("currency", "beacons", dbl("reported"), "payments", dbl("paid"))


@query
def campaign_progress(spark: SparkSession, sf: str) -> DataFrame:
    raised = (
        ledger.revenue_by_campaign(_ledger(spark, sf), _metadata(spark, sf))
        .groupBy(F.col("cmp").alias("campaign"))
        .agg(F.sum("total").alias("raised"))
    )
    sheets = (
        table(spark, sf, "events")
        .groupBy(F.concat(F.lit("cmp_"), props_k().cast("string")).alias("campaign"), props_k().alias("kk"))
        .agg(F.count("*").alias("n"))
    )
    document = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(F.col("n").cast("double").alias("total"), ((F.col("kk") + 1) * 250).cast("double").alias("goal"))
                ).alias("Sheet1")
            ).alias("sheets")
        )
    )
    goals = records.read_goal_sheets(sheets.select("campaign", document.alias("document")))
    return beacons.progress(raised, goals).select(
        "campaign", dbl("raised"), "goal", "shift_percent", "goal_thousands", "sheet_shift_percent"
    )


@query
def last_contribution(spark: SparkSession, sf: str) -> DataFrame:
    bought = inputs.request_base(table(spark, sf, "events")).where(F.col("kind") == "purchase")
    rows = bought.select(
        F.col("u").alias("browser_id"),
        F.timestamp_seconds(F.unix_seconds("ts") - F.col("kk") * 3600).alias("created"),
        F.col("ts").alias("received_at"),
        F.col("id").alias("delivery_id"),
    )
    return beacons.last_contribution(rows).select("browser_id", text_time("last_contribution"), "n_contributions")


# --- request log --------------------------------------------------------------------------------------------------------------


@query
def request_tags(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.request_base(table(spark, sf, "events")).select("id", "kind", F.when(F.col("kk") >= 10, text_id("bw", "u")).alias("bwid"))
    tags = [
        visitors.LogTag("BrowserId", F.col("bwid"), hashed=True),
        visitors.LogTag("RequestId", F.col("id").cast("string")),
        visitors.LogTag("Path", F.concat(F.lit("/"), F.col("kind"))),
    ]
    return visitors.request_tags(log, tags, inputs.SALT).select("BrowserId", "RequestId", "Path")


@query
def visitor_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.request_base(table(spark, sf, "events")).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("u"), "c_name"), "u", "left"
    )
    fields = F.to_json(
        F.array(
            F.col("u").cast("string"), F.lit("mail"), F.url_encode(F.concat("c_name", F.lit(" é?~ü"))), F.lit(""),
            F.lit(""), F.lit(""), F.lit("2016-01-01"), F.lit("true"),
        )
    )
    signed = F.translate(F.base64(F.encode(fields, "UTF-8")), "+/=", "-_,")
    log = log.select(
        "id",
        F.when(F.col("kk") < 60, F.concat(signed, F.lit(".signature"))).when(F.col("kk") < 65, "***.x").alias("user_cookie"),
        F.when(F.col("kk") > 50, "1").alias("out_cookie"),
        F.when(~every("id", 10), text_id("pv", "id")).alias("pageview"),
        F.when(every("id", 4), "").when(~every("id", 3), text_id("bw", "u")).alias("browser_cookie"),
        F.when(F.col("kind") == "purchase", text_id("ch_", "id")).alias("charge"),
        F.concat(F.lit("https://example.com/uk?a=1&INTCMP="), F.coalesce("intcmp", F.lit("")), F.when(every("id", 2), "&b=2").otherwise("#part&INTCMP=no")).alias("url"),
    )
    return beacons.visitor_dimensions(log, "user_cookie", "out_cookie", "url", "pageview", "browser_cookie", "charge")


@query
def session_platform(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    log = said.withColumns(
        {
            "body_platform": F.when((F.col("role") == "assistant") & (F.col("turn") == 3), "web-app"),
            "query_platform": F.when(F.col("role") == "system", "ios").when(
                (F.col("role") == "user") & (F.col("turn") % 4 == 2), "android"
            ),
        }
    )
    chunk = F.floor(F.col("turn") / 1024)
    return visitors.session_platform(log, "conv_id", ["turn"], chunk).select("conv_id", "turn", "platform", "is_mobile")


@query
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = running.sessions(log, "user_id", "ts", 1800, F.date_trunc("day", F.col("ts")))
    return found.select("user_id", "session_no", text_time("started"), text_time("ended"), "n_events")


@query
def landing_attribution(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    data = F.to_json(
        F.struct(
            F.concat(F.lit("cmp_"), (F.col("page_id") % 50).cast("string")).alias("campaignCode"),
            text_id("pv", "page_id").alias("referrerPageviewId"),
            F.col("url").alias("referrerUrl"),
            F.when(every("page_id", 5), "NOT_A_TYPE").otherwise("ACQUISITIONS_EPIC").alias("componentType"),
            F.lit("PARTNER_WEB").alias("source"),
            F.when(every("page_id", 3), inputs.test_pair("banner", "blue")).alias("abTest"),
        )
    )
    value = F.url_encode(F.when(every("page_id", 11), "{broken").otherwise(data))
    head, tail = F.split_part("url", F.lit("#"), F.lit(1)), F.split_part("url", F.lit("#"), F.lit(2))
    mark = F.when(F.contains(head, F.lit("?")), "&").otherwise("?")
    full = F.when(every("page_id", 13), F.col("url")).otherwise(
        F.concat(head, mark, F.lit("acquisitionData="), value, F.when(tail != "", F.concat(F.lit("#"), tail)).otherwise(""))
    )
    parsed = requests.read_landing_urls(pages.select("page_id", full.alias("url")), sources=inputs.SOURCES)
    return beacons.landing(parsed).select(
        "page_id", "outcome", "campaign_code", "referrer_pageview_id", "referrer_url", "component_type", "source",
        F.col("ab_test.name").alias("test_name"), "referrer_is_external", "query_page", "query_utm",
    )


@query
def country_routing(spark: SparkSession, sf: str) -> DataFrame:
    region = F.col("r_name")
    group = (
        F.when(region == "AFRICA", "int").when(region == "AMERICA", "us").when(region == "ASIA", "au").when(region == "EUROPE", "eu")
    )
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    countries = nations.select(text_id("N", "n_nationkey").alias("country_code"), group.alias("country_group")).where(
        F.col("country_group").isNotNull()
    )
    asked = table(spark, sf, "customer").select(
        F.when(F.col("c_mktsegment") != "MACHINERY", text_id("N", "c_nationkey")).alias("country_code")
    )
    return visitors.routing_report(asked, countries)


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    private = F.struct(F.col("c_name").alias("firstName"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("secondName"))
    user = F.struct(F.concat("c_name", F.lit("@example.com")).alias("primaryEmailAddress"), private.alias("privateFields"))
    raw = (
        table(spark, sf, "customer")
        .where(F.col("c_mktsegment") != "BUILDING")
        .select(F.col("c_custkey").alias("identity_id"), F.to_json(F.struct(user.alias("user"))).alias("document"))
    )
    return records.read_identity_users(raw)


def _signed_in(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.request_base(table(spark, sf, "events")).select("id", F.when(F.col("kk") < 70, F.col("u")).alias("identity_id"))


@query
def profile_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    found = visitors.enrich_visitors(_signed_in(spark, sf), _profiles(spark, sf), "identity_id")
    return found.select("identity_id", "n_requests", "profile_email", "profile_name")


@query
def request_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    found = visitors.enrich_requests(_signed_in(spark, sf), _profiles(spark, sf), "identity_id", "id")
    return found.select("id", "identity_id", "profile_email", "profile_name")


@query
def decline_report(spark: SparkSession, sf: str) -> DataFrame:
    failed = inputs.request_base(table(spark, sf, "events")).where(F.col("kind") == "error")
    codes = ("card_declined", "incorrect_number", "expired_card", "invalid_cvc", "processing_error", "no_such_code", "card_declined")
    declines = ("card_not_supported", "try_again_later", "do_not_honor")
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    rows = failed.select(
        F.when(F.col("kk") % 5 == 0, "api_error").when(F.col("kk") % 11 != 0, "card_error").alias("error_type"),
        pick(codes, F.col("kk")).alias("code"),
        F.when(F.col("kk") % 4 != 0, pick(declines, F.col("kk"))).alias("decline_code"),
    )
    return forms.decline_messages(rows)

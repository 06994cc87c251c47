"""Jobs on small made-up rows: the traps that an oracle over the bound tables does not show."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from donorlake.plans import acquisitions, attribution, counters, experiments, ledger, visitors
from donorlake.session import shared_dir

T0 = dt.datetime(2024, 1, 1)
ROW = (
    "contributionid string, paymentid string, provider string, created timestamp, currency string, amount decimal(18,2), "
    "convertedamount decimal(18,2), status string, email string, mode string, received_at timestamp, delivery_id bigint"
)


def hook(cid, status, n, created=None, amount=1, **extra):
    made = created or T0 + dt.timedelta(days=n)
    return (cid, f"p{n}", "Paypal", made, "GBP", Decimal(amount), extra.get("converted"), status, extra.get("email"), "Default", T0 + dt.timedelta(hours=n), n)


def test_a_late_payment_overwrites_a_refund_with_all_its_nulls(spark):
    rows = [hook("a", "Refunded", 1, email="x@x", converted=Decimal(2)), hook("a", "Paid", 2, created=T0 - dt.timedelta(days=9))]
    (got,) = ledger.payment_hooks(spark.createDataFrame(rows, ROW)).collect()
    assert (got["status"], got["email"], got["convertedamount"]) == ("Paid", None, None)
    flagged = {r["delivery_id"]: (r["is_regression"], r["is_late"]) for r in ledger.status_history(spark.createDataFrame(rows, ROW)).collect()}
    assert flagged == {1: (False, False), 2: (True, True)}


def test_a_hook_without_an_id_takes_the_payments(spark):
    cid = "1b671a64-40d5-491e-99b0-da01ff1f3341"
    hooks = spark.createDataFrame([(cid, "P1", 1), (None, "P2", 2), (None, "P3", 3), (None, "P4", 4)], "contributionid string, paymentid string, delivery_id bigint")
    payments = spark.createDataFrame([("P1", "x"), ("P2", cid.upper()), ("P3", "not an id")], "paymentid string, custom string")
    got = {r["delivery_id"]: (r["contributionid"], r["processing_error"]) for r in ledger.with_contribution_ids(hooks, payments).collect()}
    lost = (None, "Unable to find the paypal payment")
    assert got == {1: (cid, None), 2: (cid, None), 3: lost, 4: lost}


def test_a_hook_needs_its_event_but_not_a_balance(spark):
    hooks = spark.createDataFrame([("e1", 1), ("e2", 2), ("e3", 3), ("e4", 4)], "event_id string, delivery_id bigint")
    events = spark.createDataFrame([("e1", "t1"), ("e2", None), ("e3", "t3")], "event_id string, balance_transaction string")
    balances = spark.createDataFrame([("t1", 250)], "balance_transaction string, balance_minor bigint")
    got = {r["event_id"]: (r["converted_minor"], r["processing_error"]) for r in ledger.with_converted_amounts(hooks, events, balances).collect()}
    assert got == {"e1": (250, None), "e2": (None, None), "e3": (None, None), "e4": (None, "Unable to find the stripe event")}


def test_reconcile_reports_orphans_of_both_sides(spark):
    paid = ledger.payment_hooks(spark.createDataFrame([hook("a", "Paid", 1), hook("b", "Paid", 2)], ROW))
    metadata = spark.createDataFrame([("b",), ("c",)], "contributionid string")
    got = {r["side"]: r["n"] for r in ledger.reconcile(paid, metadata).collect()}
    assert got == {"ledger only": 1, "both": 1, "metadata only": 1}


def test_rollup_adds_up(spark):
    rows = [hook(str(i), s, i, amount=i) for i, s in enumerate(["Paid", "Failed", "Paid", "Refunded"])]
    got = ledger.rollup(ledger.payment_hooks(spark.createDataFrame(rows, ROW))).collect()
    by_level = {}
    for r in got:
        by_level[r["level"]] = by_level.get(r["level"], 0) + r["n"]
    assert by_level == {0: 4, 1: 4, 2: 4, 3: 4}


CONTRIBUTION = (
    "paymentid string, provider string, email string, created timestamp, amount decimal(18,2), currency string, name string, cmp string, ok boolean"
)


def test_receipts(spark):
    rows = [
        ("c1", "Stripe", "a", T0, Decimal(5), "gbp", "Ann", None, False),
        ("c2", "Stripe", "a", T0, Decimal(5), "gbp", "Ann", "co_uk_ema_cns_a", True),
        ("p1", "Paypal", "b", T0, Decimal(5), "usd", None, "co_uk_ema_cns_a2", True),
        ("p2", "Paypal", "b", T0, Decimal(5), "USD", "Bob", None, False),
    ]
    out = attribution.receipts(spark.createDataFrame(rows, CONTRIBUTION), F.col("ok"), "ext")
    got = {r["paymentid"]: r["To"]["ContactAttributes"]["SubscriberAttributes"] for r in out.collect()}
    assert set(got) == {"c1", "p1"}
    assert (got["c1"]["currency"], got["c1"]["edition"]) == ("GBP", "uk")
    assert (got["p1"]["currency"], got["p1"]["edition"], got["p1"]["name"]) == ("usd", "international", "")
    payload = attribution.receipt_payload(out).where("payload like '%Ann%'").first()["payload"]
    assert payload == (
        '{"To":{"Address":"a","SubscriberKey":"a","ContactAttributes":{"SubscriberAttributes":{"EmailAddress":"a",'
        '"created":"2024-01-01T00:00:00.000Z","amount":5.00,"currency":"GBP","edition":"uk","name":"Ann"}}},"DataExtensionName":"ext"}'
    )


def test_consents_only_for_opt_in(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "email string, opt_in boolean")
    assert [r.asDict() for r in attribution.consents(rows).collect()] == [{"email": "a", "set-consents": ["supporter"]}]


def test_attribution_from_charges(spark):
    document = (
        '{"email":"e","cmp":"","countryCode":"unknown-country-code","contributionId":"x",'
        '"abTests":"[{\\"testName\\":\\"T\\",\\"testSlug\\":\\"t\\",\\"variantName\\":\\"V\\",\\"variantSlug\\":\\"v\\"}]"}'
    )
    row = attribution.attribution_from_charges(spark.createDataFrame([(document,)], "metadata string")).first()
    assert row["email"] == "e" and row["cmp"] is None and row["country_code"] is None and row["abtests"][0]["variantSlug"] == "v"


REQUEST = (
    "paymentid string, created timestamp, currency string, amount decimal(18,2), cmp string, intcmp string, "
    "native_tests array<struct<name:string,variant:string>>, referrer_test struct<name:string,variant:string>, country string, "
    "referrer_pageview_id string, referrer_url string, component_id string, component_type string, source string, is_support boolean, "
    "pageview_id string, visit_id string, browser_id string, total decimal(18,2), has_transaction boolean, has_payer boolean"
)


def request(pid, cmp=None, intcmp=None, native=None, referrer=None, support=None, total=Decimal(5), transaction=True, payer=True):
    return (pid, T0, "gbp", Decimal(5), cmp, intcmp, native, referrer, "GB", None, None, None, None, None, support, "pv", "visit", "bw", total, transaction, payer)


def test_acquisitions(spark):
    pair = ("n", "v")
    rows = spark.createDataFrame(
        [
            request("1", "a", "a", None, None, None),
            request("2", "b", None, [pair], pair, True),
            request("3", None, None, [pair], ("m", "w"), False),
            request("4", total=None),
            request("5", transaction=False, total=None),
            request("6", payer=False),
        ],
        REQUEST,
    )
    feed = acquisitions.build({"stripe": rows.where("paymentid < '4'"), "paypal-execute": rows, "paypal-capture": rows})
    got = {(r["payment_source"], r["paymentid"]): r for r in acquisitions.events(feed).collect()}
    assert got["stripe", "1"]["campaign_codes"] == ["a"] and got["stripe", "1"]["ab_tests"] == [] and got["stripe", "1"]["platform"] == "Contribution"
    assert got["stripe", "1"]["currency"] == "gbp" and got["stripe", "2"]["platform"] == "Support"
    assert len(got["stripe", "2"]["ab_tests"]) == 1 and len(got["stripe", "3"]["ab_tests"]) == 2
    assert got["paypal-capture", "2"]["platform"] == "Contribution" and got["paypal-capture", "2"]["visit_id"] is None
    path = shared_dir(spark, "feed")
    acquisitions.write_events(feed, path, 0)
    for _ in range(2):  # a batch that runs again replaces itself and leaves the other alone
        acquisitions.write_events(feed.where("payment_source = 'stripe'"), path, 1)
    by_day = spark.read.parquet(path)
    twice = sum(source == "stripe" for source, _ in got)
    assert by_day.count() == len(got) + twice and by_day.where("day is null").count() == 0
    errors = {(r["payment_source"], r["paymentid"]): r["error"] for r in acquisitions.errors(feed).collect()}
    assert errors["paypal-execute", "4"] == "paypal-execute: unable to get amount"
    assert errors["paypal-capture", "5"] == "paypal-capture: unable to get transaction"
    assert errors["paypal-execute", "6"] == "paypal-execute: unable to get country code"
    assert len(got) + len(errors) == feed.count()


def test_a_new_payment_source_is_one_more_builder(spark):
    @acquisitions.builder("voucher")
    def voucher(df):
        return acquisitions.stripe_acquisitions(df).withColumn("payment_provider", F.lit("Voucher"))

    try:
        feed = acquisitions.build({"voucher": spark.createDataFrame([request("1")], REQUEST)})
        assert feed.first()["payment_provider"] == "Voucher"
    finally:
        del acquisitions.BUILDERS["voucher"]


def test_hook_counters_add_up(spark):
    rows = [("parsed", None), ("parsed", "lost"), ("parse-error", None), ("invalid-request", None)]
    hooks = spark.createDataFrame([("Paypal", o, e, T0, "web") for o, e in rows], "provider string, outcome string, processing_error string, received_at timestamp, platform string")
    row = counters.rates(counters.hook_metrics(hooks)).first()
    assert (row["hook_attempts"], row["parse_rate"], row["processing_rate"], row["all_accounted"]) == (4, 0.5, 0.5, True)


def test_exposure_counts_visitors_once(spark):
    alloc = [("T", "t", "V", "v")]
    rows = [("u1", False, alloc), ("u1", True, alloc), ("u2", False, alloc), ("u3", False, [])]
    df = spark.createDataFrame(rows, "u string, paid boolean, allocations array<struct<testName:string,testSlug:string,variantName:string,variantSlug:string>>")
    row = experiments.exposure(df, "u", "paid").first()
    assert (row["visitors"], row["payers"], row["rate"]) == (2, 1, 0.5)
    assert experiments.approximate_exposure(df, "u").first()["visitors"] == 2


def test_split_by_mode_is_disjoint_and_complete(spark):
    payments = spark.createDataFrame([("ann smith",), ("bob",), ("x y",), (None,)], "name string")
    real, test = visitors.split_by_mode(payments, spark.createDataFrame([("ann",), ("x",), (None,)], "user_name string"))
    assert {r["name"] for r in test.collect()} == {"ann smith", "x y"} and {r["name"] for r in real.collect()} == {"bob", None}


def test_enrich_requests_with_a_hot_visitor(spark):
    requests = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("u"), (F.col("id") % 5).cast("string"))).alias("user"))
    profiles = spark.createDataFrame([("hot", "H"), ("u1", "U")], "user string, profile string")
    got = visitors.enrich_requests(requests, profiles, "user", "id")
    assert got.count() == 500 and got.where("profile = 'H'").count() == 167


def test_session_platform(spark):
    rows = [("s", 1, None, None), ("s", 2, None, "ios"), ("s", 3, None, None), ("s", 4, "app", "android"), ("s", 5, None, None), ("t", 1, None, None)]
    df = spark.createDataFrame(rows, "s string, n int, body_platform string, query_platform string")
    got = visitors.session_platform(df, "s", ["n"], F.floor(F.col("n") / 2)).orderBy("s", "n").collect()
    assert [r["platform"] for r in got] == ["web", "ios", "ios", "app", "app", "web"]
    assert [r["is_mobile"] for r in got] == [False, True, True, False, False, False]


def test_log_tags_can_be_added(spark):
    df = spark.createDataFrame([("b", "/p"), (None, "/q")], "bwid string, path string")
    tags = [visitors.LogTag("BrowserId", F.col("bwid"), True), visitors.LogTag("Path", F.col("path")), visitors.LogTag("Stage", F.lit("TEST"))]
    got = visitors.request_tags(df, tags, "salt").collect()
    assert [r["Stage"] for r in got] == ["TEST", "TEST"] and got[1]["BrowserId"] == "unknown" and len(got[0]["BrowserId"]) == 64


def test_test_user_name_of_a_request(spark):
    df = spark.createDataFrame([("q", "c", "p"), (None, "c", "p"), (None, None, "p"), (None, None, None)], "q string, c string, p string")
    users = spark.createDataFrame([("c",), ("q",), (None,)], "user_name string")
    got = {r["mode"]: r["n"] for r in visitors.request_mode_report(df, "q", "c", "p", users).collect()}
    assert got == {"Testing": 2, "Default": 2}


def test_payments_without_a_number_are_not_stored(spark):
    df = spark.createDataFrame([("c", "e", 1), ("c", "e", None), (None, "e", 1), ("c", None, 1)], "contributionid string, email string, amount int")
    assert attribution.storable(df).count() == 1


def test_intcmp_comes_from_the_query_part(spark):
    from donorlake.plans import beacons

    urls = ["https://x/?INTCMP=abc#part", "https://x/?a=1&INTCMP=d&b", "https://x/#INTCMP=no", "https://x/?a#INTCMP=no", "https://x/?INTCMP="]
    df = spark.createDataFrame([(i, None, None, u, "pv", "", None) for i, u in enumerate(urls)], "i int, u string, o string, url string, pv string, bw string, ch string")
    got = beacons.visitor_dimensions(df, "u", "o", "url", "pv", "bw", "ch").orderBy("i").collect()
    assert [r["intcmp"] for r in got] == ["abc", "d", None, None, None] and got[0]["browser_id"] is None and got[0]["pageview_id"] == "pv"


PAYMENT_LOG = "kind string, document string, received_at timestamp, delivery_id bigint, given_id string, contributor_id string"
REQUEST_LOG = "kind string, document string, asked_at timestamp, charge_id string, session_platform string, session_iduser string, allocations array<struct<testName:string,testSlug:string,variantName:string,variantSlug:string>>"
KEY = "00000000-0000-4000-8000-000000000001"


def charge(n):
    return ("stripe", f'{{"id":"ch_{n}","amount":500,"currency":"gbp","created":1,"receipt_email":"e{n}","source":{{"country":"c"}}}}', T0, n, KEY, "x")


def paid(n, kind="paypal-execute", state="approved", total='"5.00"', email='"e"', custom=f'"{KEY}"'):
    transaction = f'{{"amount":{{"total":{total},"currency":"GBP"}},"custom":{custom}}}'
    document = f'{{"id":"P{n}","state":"{state}","payer":{{"payer_info":{{"email":{email},"country_code":"c"}}}},"transactions":[{transaction}]}}'
    return (kind, document, T0, n, None, "x")


def form(n, token='"t"', minutes=5):
    document = f'{{"name":"N{n}","currency":"gbp","amount":5,"email":"m","token":{token},"pageviewId":"pv{n}","cmp":"c{n}"}}'
    return ("stripe", document, T0 - dt.timedelta(minutes=minutes), f"ch_{n}", None, None, [])


def came_back(n, minutes=5):
    url = f"https://x/execute?{'' if n is None else f'paymentId=P{n}&'}token=T&PayerID=Y&pvid=pv{n}"
    return ("paypal-execute", url, T0 - dt.timedelta(minutes=minutes), None, "web", "u", [])


def captured(n):
    return ("paypal-capture", f'{{"paymentId":"P{n}","platform":"ios","idUser":"app"}}', T0, None, None, None, [])


PAYMENTS = [
    charge(1), charge(2), charge(3), paid(4), paid(5), paid(6, state="failed"), paid(7, total='"n/a"'), paid(8, custom='"no-id"'),
    paid(9, email="null"), paid(10, "paypal-capture", "Completed"), paid(11, "paypal-capture", "approved"), ("gift", "{}", T0, 12, None, None),
]
REQUESTS = [
    form(1), form(1), form(2, "null"), form(90), came_back(4), came_back(None), came_back(6), came_back(7), came_back(8), came_back(9),
    captured(10), captured(11), captured(5), ("stripe", "no json", T0, "ch_3", None, None, []),
]
OUTCOMES = {
    1: "stored", 2: "no request", 3: "no request", 4: "not stored", 5: "no request", 6: "not approved", 7: "not storable",
    8: "not storable", 9: "not storable", 10: "stored", 11: "not approved", 12: "not approved",
}


def logs(spark):
    from donorlake.sources import records, requests

    payments = records.read_payments(spark.createDataFrame(PAYMENTS, PAYMENT_LOG))
    return payments, requests.read_requests(spark.createDataFrame(REQUESTS, REQUEST_LOG))


def test_every_payment_and_request_is_accounted_for(spark):
    payments, asked = logs(spark)
    contributions = attribution.contributions(payments, asked).cache()
    stored = F.col("delivery_id") != 4
    told = attribution.with_outcomes(contributions, stored).collect()
    assert {r["delivery_id"]: r["outcome"] for r in told} == OUTCOMES and len(told) == len(PAYMENTS)
    by_id = {r["delivery_id"]: r for r in told}
    assert (by_id[1]["name"], by_id[1]["cmp"], by_id[1]["pageview_id"]) == ("N1", "c1", "pv1")
    assert (by_id[4]["iduser"], by_id[4]["platform"], by_id[10]["iduser"], by_id[10]["platform"]) == ("u", "web", "app", "ios")
    assert [by_id[k]["reason"] for k in (7, 8, 9)] == ["amount", "contribution id", "payer"]
    rows = attribution.accounts(contributions, payments, asked, stored).collect()
    total = {side: sum(r["n"] for r in rows if r["side"] == side) for side in ("payment", "request")}
    assert total == {"payment": len(PAYMENTS), "request": len(REQUESTS)}
    requests_ = {(r["kind"], r["outcome"], r["reason"]): r["n"] for r in rows if r["side"] == "request"}
    assert requests_["stripe", "rejected", "token"] == 1 and requests_["stripe", "rejected", "not json"] == 1
    assert requests_["stripe", "repeated", "repeated"] == 1 and requests_["stripe", "no payment", "no payment"] == 1
    assert requests_["paypal-execute", "rejected", "paymentId"] == 1 and requests_["paypal-capture", "no payment", "no payment"] == 1
    dead = {(r["raw"], r["stage"]) for r in attribution.dead_letters(contributions, asked, stored).collect()}
    lost = {PAYMENTS[k - 1][1] for k, outcome in OUTCOMES.items() if outcome != "stored"}
    assert dead == {(raw, "payment") for raw in lost} | {(REQUESTS[k][1], "request") for k in (2, 5, 13)}

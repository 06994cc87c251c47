import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from donorlake.plans import ledger
from donorlake.sources.webhooks import read_paypal_hooks, read_stripe_hooks

CID = "1b671a64-40d5-491e-99b0-da01ff1f3341"


def paypal(**changes):
    resource = {
        "id": "SALE1",
        "parent_payment": "PAY-1",
        "custom": CID,
        "create_time": "2021-03-04T05:06:07Z",
        "amount": {"total": "31.40", "currency": "GBP", "details": {}},
        "links": [{"href": "https://example.com", "rel": "self"}],
    }
    document = {"id": "WH-1", "create_time": "2021-03-04T05:07:08Z", "event_type": "PAYMENT.SALE.COMPLETED"}
    for key, value in changes.items():
        target = document if key == "event_type" else resource
        if value is ...:
            del target[key]
        else:
            target[key] = value
    return json.dumps({**document, "resource": resource})


def stripe(metadata=None, **changes):
    charge = {
        "id": "ch_1",
        "livemode": False,
        "created": 1620000000,
        "currency": "gbp",
        "amount": 4750,
        "status": "succeeded",
        "refunded": False,
        "metadata": {"contributionId": CID, "email": "donor@example.org", "countryCode": "nz", "abTests": "[]"},
    }
    charge["metadata"].update(metadata or {})
    for key, value in changes.items():
        if value is ...:
            del charge[key]
        else:
            charge[key] = value
    return json.dumps({"id": "evt_1", "object": "event", "data": {"object": charge}})


def read(spark, reader, *documents):
    rows = reader(spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, document string"))
    return [r.asDict() for r in rows.orderBy("i").collect()]


def test_paypal_sample(spark):
    (row,) = read(spark, read_paypal_hooks, paypal())
    assert row["problem"] is None
    assert row["contributionid"] == CID and row["paymentid"] == "PAY-1" and row["provider"] == "Paypal"
    assert row["created"] == dt.datetime(2021, 3, 4, 5, 6, 7)
    assert (row["currency"], row["amount"], row["status"], row["email"]) == ("GBP", Decimal("31.40"), "Paid", None)


def test_stripe_sample(spark):
    (row,) = read(spark, read_stripe_hooks, stripe())
    assert row["problem"] is None
    assert row["contributionid"] == CID and row["paymentid"] == "ch_1" and row["event_id"] == "evt_1"
    assert row["created"] == dt.datetime(2021, 5, 3, 0, 0, 0)
    assert (row["currency"], row["amount"], row["status"]) == ("GBP", Decimal("47.50"), "Paid")
    assert (row["email"], row["mode"], row["country_code"]) == ("donor@example.org", "Testing", "nz")


@pytest.mark.parametrize(
    "document, problem",
    [
        ("nonsense", "not json"),
        ("", "not json"),
        ('{"resource": ', "not json"),
        ("[" + paypal() + "]", "not json"),
        ("{}", "resource"),
        ('{"resource": 5}', "resource"),
        (paypal(parent_payment=...), "parent_payment"),
        (paypal(parent_payment=5), "parent_payment"),
        (paypal(parent_payment={"a": 1}), "parent_payment"),
        (paypal(custom="not-an-id"), "custom"),
        (paypal(custom=7), "custom"),
        (paypal(custom=None), None),
        (paypal(custom=...), None),
        (paypal(create_time="yesterday-ish"), "create_time"),
        (paypal(amount={"currency": "GBP"}), "total"),
        (paypal(amount={"currency": "GBP", "total": "12x"}), "total"),
        (paypal(amount={"currency": "GBP", "total": 12.5}), None),
        (paypal(event_type="PAYMENT.SALE.PENDING"), "event_type"),
        (paypal(event_type=...), "event_type"),
    ],
)
def test_paypal_rejections(spark, document, problem):
    assert read(spark, read_paypal_hooks, document)[0]["problem"] == problem


@pytest.mark.parametrize(
    "document, problem",
    [
        (stripe(amount="4750"), "amount_minor"),
        (stripe(amount=25.5), "amount_minor"),
        (stripe(livemode="true"), "livemode"),
        (stripe(refunded=...), "refunded"),
        (stripe(status="pending"), "charge_status"),
        (stripe(metadata={"email": 5}), "email"),
        (stripe(metadata={"contributionId": "x"}), "contribution_id"),
        (stripe(metadata={"countryCode": None}), "country_code"),
        (stripe(amount=4750.0), None),
    ],
)
def test_stripe_rejections(spark, document, problem):
    assert read(spark, read_stripe_hooks, document)[0]["problem"] == problem


def test_refund_overrides_any_status(spark):
    rows = read(spark, read_stripe_hooks, stripe(refunded=True), stripe(status="failed", refunded=True), stripe(status="failed"))
    assert [r["status"] for r in rows] == ["Refunded", "Refunded", "Failed"]


def test_statuses(spark):
    events = [f"PAYMENT.{kind}.{end}" for kind in ("SALE", "CAPTURE") for end in ("COMPLETED", "DENIED", "REFUNDED")]
    rows = read(spark, read_paypal_hooks, *[paypal(event_type=e) for e in events])
    assert [r["status"] for r in rows] == ["Paid", "Failed", "Refunded"] * 2


def test_repeated_key_last_wins(spark):
    document = paypal().replace('"parent_payment": "PAY-1"', '"parent_payment": "PAY-0", "parent_payment": "PAY-1"')
    assert read(spark, read_paypal_hooks, document)[0]["paymentid"] == "PAY-1"


def test_money_is_rounded_half_up_not_cut(spark):
    rows = read(spark, read_paypal_hooks, *[paypal(amount={"currency": "GBP", "total": t}) for t in ("1.005", "1.004", "1e2")])
    assert [r["amount"] for r in rows] == [Decimal("1.01"), Decimal("1.00"), Decimal("100.00")]


def test_triage_is_disjoint_and_complete(spark):
    documents = [(0, paypal(), True), (1, paypal(), False), (2, "x", True), (3, "x", False)]
    raw = spark.createDataFrame(documents, "i int, document string, signature_ok boolean")
    hooks = ledger.triage(read_paypal_hooks(raw), F.col("signature_ok"))
    assert [r["outcome"] for r in hooks.orderBy("i").collect()] == [
        "parsed", "invalid-request", "parse-error", "parse-error",
    ]
    dead = ledger.dead_letters(hooks, "paypal").collect()
    assert ledger.parsed(hooks).count() + len(dead) == 4
    assert {(r["reason"], r["stage"]) for r in dead} == {("not signed", "invalid-request"), ("not json", "parse-error")}

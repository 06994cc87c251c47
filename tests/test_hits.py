"""Hits are read by their own kind, or turned away for one reason."""

from __future__ import annotations

import json

import pytest

from donorlake.sources import hits

HEAD = {"pageviewId": "p", "clientId": "b"}
STEP = {**HEAD, "hitType": "event", "eventCategory": "Checkout", "eventAction": "pay", "productAction": "checkout", "step": 3}
PAID = {**HEAD, "hitType": "event", "productAction": "purchase", "revenue": 12.5, "currency": "gbp"}
CASES = {
    "view": ({**HEAD, "hitType": "pageview"}, "pageview", None),
    "event": ({**HEAD, "hitType": "event", "eventCategory": "Form", "eventAction": "error", "eventValue": 2}, "event", None),
    "step": (STEP, "checkout", None),
    "paid": (PAID, "purchase", None),
    "quoted price": ({**PAID, "revenue": "7.25"}, "purchase", None),
    "no page view": ({"clientId": "b", "hitType": "pageview"}, None, "pageview_id"),
    "unknown type": ({**HEAD, "hitType": "timing"}, None, "hit_type"),
    "unknown product action": ({**STEP, "productAction": "refund"}, None, "product_action"),
    "no such step": ({**STEP, "step": 5}, None, "step"),
    "step as text": ({**STEP, "step": "3"}, None, "step"),
    "step left out": ({k: v for k, v in STEP.items() if k != "step"}, None, "step"),
    "null step": ({**STEP, "step": None}, None, "step"),
    "event without action": ({**HEAD, "hitType": "event", "eventCategory": "Form"}, None, "action"),
    "price is no number": ({**PAID, "revenue": "n/a"}, None, "price"),
    "no currency": ({k: v for k, v in PAID.items() if k != "currency"}, None, "currency"),
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(name, json.dumps(document)) for name, (document, _, _) in CASES.items()]
    rows += [("broken", '{"hitType":"pageview"'), ("list", "[1]"), ("empty", ""), ("absent", None)]
    return hits.read_hits(spark.createDataFrame(rows, "name string, document string")).cache()


def test_kinds_and_reasons(read):
    found = {r["name"]: (r["kind"], r["problem"]) for r in read.collect()}
    assert {name: found[name] for name in CASES} == {name: (kind, problem) for name, (_, kind, problem) in CASES.items()}
    assert all(found[name] == (None, "not json") for name in ("broken", "list", "empty", "absent"))


def test_values_are_typed(read):
    by_name = {r["name"]: r for r in read.collect()}
    assert (by_name["step"]["step"], by_name["event"]["value"]) == (3, 2)
    assert (float(by_name["paid"]["price"]), by_name["paid"]["currency"]) == (12.5, "GBP")
    assert float(by_name["quoted price"]["price"]) == 7.25


def test_rejected_hits_keep_their_text(read):
    dead = {r["raw"]: r["reason"] for r in hits.rejected(read).collect()}
    assert dead[json.dumps(CASES["no such step"][0])] == "step" and dead["[1]"] == "not json"
    assert len(dead) == sum(problem is not None for _, _, problem in CASES.values()) + 4


def test_a_log_without_rows(spark):
    none = hits.read_hits(spark.createDataFrame([], "name string, document string"))
    assert none.collect() == [] and hits.rejected(none).collect() == []

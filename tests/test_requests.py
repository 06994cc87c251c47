import json
from decimal import Decimal
from urllib.parse import urlencode

from donorlake.sources import records, requests

SOURCES = ("PartnerWeb", "PartnerApps")
REQUIRED = {
    "name": "Ann", "currency": "gbp", "amount": "10.0", "email": "a@a.a", "token": "tok", "sitePageviewId": "pv",
}


def rows(spark, reader, *documents, **options):
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, document string")
    return [r.asDict(True) for r in reader(raw, **options).orderBy("i").collect()]


def card(spark, **extra):
    return rows(spark, requests.read_card_requests, {**REQUIRED, **extra}, id_prefix="site", sources=SOURCES)[0]


def test_card_required_fields_only(spark):
    row = card(spark)
    assert row["problem"] is None
    assert (row["currency"], row["amount"], row["pageview_id"]) == ("GBP", Decimal(10), "pv")
    assert row["postcode"] is None and row["native_tests"] is None
    assert "token" not in row


def test_card_optional_fields(spark):
    row = card(
        spark, componentId="c1", componentType="ACQUISITIONS_ENGAGEMENT_BANNER", source="partner_apps", other=1,
        refererAbTest={"name": "n", "variant": "v"}, nativeAbTests=[{"name": "a", "variant": "b"}] * 2, isSupport=True,
    )
    assert row["problem"] is None
    assert (row["component_type"], row["source"]) == ("AcquisitionsEngagementBanner", "PartnerApps")
    assert row["referrer_test"] == {"name": "n", "variant": "v"}
    assert row["native_tests"] == [{"name": "a", "variant": "b"}] and row["is_support"] is True


def test_card_rejections(spark):
    bad = [
        {**REQUIRED, "currency": "xyz"}, {**REQUIRED, "amount": "ten"}, {k: v for k, v in REQUIRED.items() if k != "token"},
        {**REQUIRED, "componentType": "NOPE"}, {**REQUIRED, "isSupport": "yes"}, {**REQUIRED, "refererAbTest": {"name": "n"}},
    ]
    got = rows(spark, requests.read_card_requests, *bad, id_prefix="site", sources=SOURCES)
    assert [r["problem"] for r in got] == ["currency", "amount", "token", "component_type", "is_support", "referrer_test"]


def test_card_path_has_no_minimum(spark):
    assert card(spark, amount=0.5)["problem"] is None


def test_auth_request(spark):
    base = {"countryGroup": "uk", "amount": 1, "refererUrl": "https://x.example.com/a?b=1#frag"}
    good, small, group = rows(
        spark, requests.read_auth_requests, base, {**base, "amount": 0.99}, {**base, "countryGroup": "moon"}
    )
    assert good["problem"] is None and good["referrer_url"] == "https://x.example.com/a?b=1"
    assert (small["problem"], group["problem"]) == ("amount", "country_group")


def test_capture_request(spark):
    base = {"paymentId": "PAY-1", "platform": "ios", "abTest": {"name": "old", "variant": "x"}}
    good, missing = rows(spark, requests.read_capture_requests, base, {"paymentId": "PAY-1"})
    assert good["problem"] is None and "deprecated_test" not in good
    assert missing["problem"] == "platform"


def return_url(**params):
    return "https://pay.example.com/paypal/uk/execute?" + urlencode(params)


def test_return_urls(spark):
    required = {"paymentId": "PAY-1", "token": "t", "PayerID": "p"}
    tests = json.dumps([{"name": "a", "variant": "b & c"}])
    urls = [
        return_url(**required, CMP="", INTCMP="x y", nativeAbTests=tests, supportRedirect="true", siteVisitId="v1"),
        return_url(paymentId="PAY-1", token="t"),
        return_url(**required, componentType="NOPE"),
        return_url(**required) + "&CMP=first&CMP=second#end",
    ]
    raw = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = [r.asDict(True) for r in requests.read_return_urls(raw, id_prefix="site").orderBy("i").collect()]
    assert got[0]["problem"] is None and got[0]["cmp"] == "" and got[0]["intcmp"] == "x y" and got[0]["visit_id"] == "v1"
    assert got[0]["native_tests"] == [{"name": "a", "variant": "b & c"}] and got[0]["is_support"] is True
    assert [r["problem"] for r in got[1:]] == ["PayerID", "component_type", None]
    assert got[3]["cmp"] == "first"


def test_landing_urls(spark):
    data = json.dumps({"campaignCode": "c", "source": "PARTNER_WEB", "referrerUrl": "https://a.example.com/x#y"})
    urls = [
        "https://x.example.com/uk?" + urlencode({"acquisitionData": data}),
        "https://x.example.com/uk?a=1",
        "https://x.example.com/uk?acquisitionData=%7Bbroken",
        "https://x.example.com/uk?" + urlencode({"acquisitionData": json.dumps({"campaignCode": 3})}),
    ]
    raw = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = [r.asDict(True) for r in requests.read_landing_urls(raw, sources=SOURCES).orderBy("i").collect()]
    assert [r["problem"] for r in got] == [None, "not found", "not json", "campaign_code"]
    assert got[0]["campaign_code"] == "c" and got[0]["source"] == "PartnerWeb"


def payment(**changes):
    base = {
        "id": "PAY-1", "state": "approved", "create_time": "2017-01-02T03:04:05Z",
        "payer": {"payer_info": {"email": "p@a.a", "first_name": "P", "country_code": "GB"}},
        "transactions": [
            {"amount": {"total": "5.50", "currency": "GBP"}, "custom": "id",
             "item_list": {"shipping_address": {"postal_code": "S1"}},
             "related_resources": [{"authorization": {"id": "auth1"}}]},
            {"amount": {"total": "9.99", "currency": "USD"}},
        ],
        "links": [{"rel": "self", "href": "a"}, {"rel": "APPROVAL_URL", "href": "b"}, {"rel": "approval_url", "href": "c"}],
    }
    return {**base, **changes}


def test_payment_records(spark):
    raw = spark.createDataFrame(
        [(0, json.dumps(payment())), (1, json.dumps(payment(transactions=[], links=[]))), (2, json.dumps(payment(payer=None)))],
        "i int, document string",
    )
    first, empty, nobody = [r.asDict() for r in records.approval(records.read_paypal_payments(raw)).orderBy("i").collect()]
    assert (first["total"], first["currency"], first["postcode"]) == (Decimal("5.50"), "GBP", "S1")
    assert (first["name"], first["authorization_id"], first["approval_url"]) == ("P", "auth1", "b")
    assert first["approval_error"] is None and empty["approval_error"] == "Unable to parse payment"
    assert empty["has_transaction"] is False and nobody["has_payer"] is False


def test_texts_that_are_not_asked_for_are_checked_all_the_same(spark):
    card = '{"name": "N", "currency": "gbp", "amount": 5, "email": "a@b", "token": "t", "sitePageviewId": "p"%s}'
    capture = '{"paymentId": "P1", "platform": "ios"%s}'
    url = "https://pay.example.com/x?paymentId=P2&token=t&PayerID=q&CMP=c%s"
    documents = [("stripe", card % more) for more in ("", ', "cmp": 5', ', "cmp": null', ', "cmp": "c", "idUser": true', ', "cmp": {"a": 1}', ', "source": "?"')]
    documents += [("stripe", text) for text in ('{"name": 5}', '{"name": null}', "{", "[]", "", None, card.replace('"N"', "null") % "", card.replace('"a@b"', "[]") % "")]
    documents += [("paypal-capture", capture % more) for more in ("", ', "intCmp": 1', ', "abTest": {"name": "n"}')] + [("paypal-capture", '{"paymentId": 1}')]
    documents += [("paypal-execute", url % more) for more in ("", "&INTCMP=%zz", "&supportRedirect=maybe", "&source=x&componentType=y")]
    documents += [("paypal-execute", "https://pay.example.com/x?token=t"), ("end", "x")]
    schema = "kind string, document string, charge_id string, session_platform string, session_iduser string, n int"
    log = spark.createDataFrame([(kind, text, "ch" if kind == "stripe" else None, None, "u", n) for n, (kind, text) in enumerate(documents)], schema)
    read = lambda asked: requests.read_requests(log, id_prefix="site", sources=("PartnerWeb",), asked=asked)
    whole, narrow = read(None), read(("cmp",))
    assert narrow.schema == whole.schema
    same = ["n", "kind", "paymentid", "problem", "cmp", "component_type", "source", "native_tests", "is_support"]
    rows = lambda df: sorted(df.select(same).collect(), key=lambda r: r["n"])
    assert rows(narrow) == rows(whole)
    assert len({r["problem"] for r in rows(whole)}) > 8
    assert narrow.where("email IS NOT NULL OR browser_id IS NOT NULL OR referrer_url IS NOT NULL").count() == 0

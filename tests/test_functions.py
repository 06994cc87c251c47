import base64
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from donorlake.functions import cookies, money, text, urls
from donorlake.functions.text import slug
from donorlake.plans import attribution, beacons, forms, visitors


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {_ddl(v)}" for k, v in values.items()) or "x int")
    return frame.select(column.alias("out")).first()["out"]


def _ddl(value):
    return {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "string", Decimal: "decimal(18,6)"}[type(value)]


@pytest.mark.parametrize(
    "amount, currency, paypal, stripe",
    [
        ("10.005", "GBP", "10.01", 1000),
        ("10.009", "GBP", "10.01", 1000),
        ("1999.999", "USD", "2000.00", 199999),
        ("2000.01", "EUR", "2000.00", 200000),
        ("15999.99", "AUD", "15999.99", 1599999),
        ("16000.01", "AUD", "16000.00", 1600000),
        ("30000000", "GBP", "2000.00", 200000),
    ],
)
def test_caps(spark, amount, currency, paypal, stripe):
    a, c = F.col("a"), F.col("c")
    values = {"a": Decimal(amount), "c": currency}
    assert one(spark, money.capped_paypal_amount(a, c), **values) == Decimal(paypal)
    assert one(spark, money.capped_stripe_minor(a, c), **values) == stripe


@pytest.mark.parametrize(
    "shown, amount, currency",
    [("25.00GBP", Decimal(25), "GBP"), ("xGBP", None, "GBP"), ("25XXX", None, None), ("GB", None, None), ("", None, None)],
)
def test_amount_text(spark, shown, amount, currency):
    assert one(spark, money.amount_part(F.col("t")), t=shown) == amount
    assert one(spark, money.currency_part(F.col("t")), t=shown) == currency


def test_show_and_display_amount(spark):
    assert one(spark, money.show_amount(F.col("a"), F.lit("GBP")), a=Decimal("3.125")) == "3.13GBP"
    for given, shown in (("3", "3"), ("3.12", "3.12"), ("3.123456", "3.12")):
        assert one(spark, money.display_amount(F.col("a")), a=Decimal(given)) == Decimal(shown)


@pytest.mark.parametrize("total, goal, shift", [(0, 100, -100), (50, 100, -50), (33, 200, -84), (100, 100, 0), (500, 100, 0)])
def test_progress(spark, total, goal, shift):
    assert one(spark, money.progress_shift(F.col("t"), F.col("g")), t=total, g=goal) == shift


@pytest.mark.parametrize(
    "first, last, full, display",
    [("A", "B", "A B", "A B"), ("A", None, "A", None), (None, "B", "B", None), (None, None, None, None)],
)
def test_names(spark, first, last, full, display):
    a, b = F.col("a"), F.col("b")
    assert one(spark, text.full_name(a, b), a=first, b=last) == full
    assert one(spark, text.display_name(a, b), a=first, b=last) == display


@pytest.mark.parametrize(
    "encoded, member",
    [
        ("ACQUISITIONS_EPIC", "AcquisitionsEpic"),
        ("ACQUISITIONS_ENGAGEMENT_BANNER", "AcquisitionsEngagementBanner"),
        ("ACQUISITIONS_THRASHER", "AcquisitionsThrasher"),
    ],
)
def test_enum_texts(spark, encoded, member):
    from donorlake.fixed_values import COMPONENT_TYPES

    assert one(spark, text.encode_enum(F.col("m")), m=member) == encoded
    for variant in (encoded, encoded.lower(), member):
        assert one(spark, text.decode_enum(F.col("t"), COMPONENT_TYPES), t=variant) == member
    assert one(spark, text.decode_enum(F.col("t"), COMPONENT_TYPES), t="OTHER") is None


@pytest.mark.parametrize("given, out", [("Stripe checkout", "stripe-checkout"), ("  A & b!", "a-b"), ("with-copy", "with-copy")])
def test_slug(spark, given, out):
    assert one(spark, slug(F.col("t")), t=given) == out


@pytest.mark.parametrize(
    "url, out",
    [("https://x/?a=1&amount=5+6%21#z", "5 6!"), ("https://x/?amount", ""), ("https://x/?amount=&b", ""), ("https://x/?amounts=3", None)],
)
def test_url_parameter(spark, url, out):
    assert one(spark, urls.url_parameter(F.col("u"), "amount"), u=url) == out


def test_fragments_and_hosts(spark):
    assert one(spark, urls.without_fragment(F.col("u")), u="https://x/a?b#c#d") == "https://x/a?b"
    assert one(spark, urls.without_fragment(F.col("u")), u="ht tp://[") is None
    assert one(spark, urls.is_external(F.col("u")), u="https://x/a") is True
    assert one(spark, urls.is_external(F.col("u")), u="/a/b") is False


def test_hashing(spark):
    hashed = [one(spark, text.salted_hash(F.col("t"), salt), t="abc123xyz0") for salt in ("s1", "s1", "s2")]
    assert hashed[0] == hashed[1] != hashed[2] and len(hashed[0]) == 64 and hashed[0] != "abc123xyz0"


def test_cookie_user(spark):
    fields = ["42", "m", "J%C3%B6rg%20%3F", "", "", "", "2016", "true"]
    cookie = base64.b64encode(json.dumps(fields).encode()).decode().replace("+", "-").replace("/", "_").replace("=", ",")
    user = one(spark, cookies.cookie_user(F.col("c")), c=cookie + ".sig.more")
    assert (user["id"], user["display_name"], user["account_created"], user["email_verified"]) == ("42", "Jörg ?", "2016", "true")
    for bad in ("***.x", "", "aGVsbG8.x"):
        assert one(spark, cookies.cookie_user(F.col("c")), c=bad)["id"] is None


def test_paypal_errors(spark):
    kinds = {"INVALID_RESOURCE_ID": "NotFound", "PAYMENT_ALREADY_DONE": "PaymentAlreadyDone", "INSTRUMENT_DECLINED": "InstrumentDeclined", "X": "Other"}
    for name, kind in kinds.items():
        assert one(spark, text.paypal_error_type(F.col("n")), n=name) == kind
    assert one(spark, text.paypal_error_message(F.col("m")), m="") == "Unknown error message"


def test_browser_length_counts_utf16_units(spark):
    assert one(spark, text.browser_length(F.col("t")), t="aé😀") == 4


def test_editions_groups_and_paths(spark):
    editions = {"GBP": "uk", "USD": "us", "AUD": "au", "EUR": "international"}
    assert {c: one(spark, attribution.edition(F.col("c")), c=c) for c in editions} == editions
    groups = {"USD": "us", "AUD": "au", "EUR": "eu", "GBP": "uk", "CAD": "uk"}
    assert {c: one(spark, visitors.card_country_group(F.col("c")), c=c) for c in groups} == groups
    assert one(spark, visitors.country_group_path(F.col("c")), c="nowhere") == "uk"
    assert one(spark, visitors.country_group_path(F.col("c")), c=None) == "uk"


@pytest.mark.parametrize(
    "entered, selected, rule",
    [(2001, 0, "above maximum"), (0, 0, "no amount"), (None, None, "no amount"), (0, 50, "ok"), (0.5, 0, "below minimum"), (1, 0, "ok")],
)
def test_amount_rule(spark, entered, selected, rule):
    typed = F.lit(entered).cast("double")
    assert one(spark, forms.amount_rule(typed, F.lit(selected).cast("double"), F.lit("GBP"))) == rule


def test_presets(spark):
    preset = lambda amount, group, override=None: one(
        spark, forms.is_preset(F.lit(amount), F.lit(group), F.array(*map(F.lit, override)) if override else F.lit(None).cast("array<int>"))
    )
    assert preset(500, "au") and not preset(25, "au") and preset(25, "uk") and preset(25, None)
    assert preset(3, "uk", [3, 7]) and not preset(25, "uk", [3, 7])
    for group, override, amount in (("au", None, 100), ("uk", None, 50), (None, None, 50), ("au", 7, 7)):
        assert one(spark, forms.preselected_amount(F.lit(group), F.lit(override).cast("int"))) == amount


def test_field_rules(spark):
    rows = spark.createDataFrame([("abc",), ("",), (None,), ("abcdef",)], "v string")
    rules = forms.rules_from_rows(
        [
            {"rule_id": "req", "column": "v", "required": True},
            {"rule_id": "len", "column": "v", "min_length": 2, "max_length": 4},
            {"rule_id": "pat", "column": "v", "pattern": "^[a-c]*$"},
            {"rule_id": "off", "column": "v", "required": True, "disabled": True},
            {"rule_id": "site", "column": "v", "profile": "v = 'abc'"},
        ]
    )
    got = {r["rule_id"]: r["n_valid"] for r in forms.rule_report(rows, rules).collect()}
    assert got == {"req": 2, "len": 1, "pat": 3, "off": 4, "site": 1}


def test_step_four_counts_every_time(spark):
    rows = [("web", "p", 1), ("web", "p", 1), ("web", "p", 4), ("web", "p", 4), ("web", "q", 1)]
    got = beacons.funnel(spark.createDataFrame(rows, "platform string, pageview_id string, step int")).first()
    assert (got["step_1"], got["step_2"], got["step_4"], got["rate_4"]) == (2, 0, 2, 1.0)


def test_decline_messages(spark):
    from donorlake import fixed_values as fixed

    rows = [
        ("card_error", "card_declined", "card_not_supported"), ("card_error", "card_declined", "odd"), ("card_error", "card_declined", None),
        ("card_error", "expired_card", None), ("card_error", "odd", None), ("api_error", "expired_card", None), (None, None, None),
    ]
    got = {r["message"]: r["n"] for r in forms.decline_messages(spark.createDataFrame(rows, "error_type string, code string, decline_code string")).collect()}
    assert got == {
        fixed.DECLINE_MESSAGES["card_not_supported"]: 1,
        fixed.DECLINE_MESSAGES["generic_decline"]: 2,
        fixed.CARD_ERROR_MESSAGES["expired_card"]: 1,
        fixed.GENERIC_ERROR_MESSAGE: 3,
    }

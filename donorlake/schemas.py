"""Schemas of the tables the jobs write, and of the provider records they read."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# Money is read at a wider scale than it is kept at, so that rounding is always a choice (see functions.money).
WIDE_MONEY = T.DecimalType(38, 10)

AB_TEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("variant", T.StringType())])
AB_TESTS = T.ArrayType(AB_TEST)

ALLOCATION = T.StructType(
    [
        T.StructField("testName", T.StringType()),
        T.StructField("testSlug", T.StringType()),
        T.StructField("variantName", T.StringType()),
        T.StructField("variantSlug", T.StringType()),
    ]
)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


PAYMENT_HOOKS = _table(
    ("contributionid", T.StringType()),
    ("paymentid", T.StringType()),
    ("provider", T.StringType()),
    ("created", T.TimestampType()),
    ("currency", T.StringType()),
    ("amount", MONEY),
    ("convertedamount", MONEY),
    ("status", T.StringType()),
    ("email", T.StringType()),
)

CONTRIBUTION_METADATA = _table(
    ("contributionid", T.StringType()),
    ("created", T.TimestampType()),
    ("email", T.StringType()),
    ("country", T.StringType()),
    ("pageview_id", T.StringType()),
    ("browser_id", T.StringType()),
    ("abtests", T.ArrayType(ALLOCATION)),
    ("cmp", T.StringType()),
    ("intcmp", T.StringType()),
    ("referer_url", T.StringType()),
    ("referer_pageview_id", T.StringType()),
    ("platform", T.StringType()),
)

LIVE_CONTRIBUTORS = _table(
    ("receipt_email", T.StringType()),
    ("name", T.StringType()),
    ("firstname", T.StringType()),
    ("lastname", T.StringType()),
    ("iduser", T.StringType()),
    ("postcode", T.StringType()),
    ("contributor_id", T.StringType()),
    ("updated", T.TimestampType()),
)

ACQUISITIONS = _table(
    ("product", T.StringType()),
    ("payment_frequency", T.StringType()),
    ("currency", T.StringType()),
    ("amount", T.DoubleType()),
    ("payment_provider", T.StringType()),
    ("campaign_codes", T.ArrayType(T.StringType())),
    ("ab_tests", AB_TESTS),
    ("country_code", T.StringType()),
    ("referrer_pageview_id", T.StringType()),
    ("referrer_url", T.StringType()),
    ("component_id", T.StringType()),
    ("component_type", T.StringType()),
    ("source", T.StringType()),
    ("platform", T.StringType()),
    ("pageview_id", T.StringType()),
    ("visit_id", T.StringType()),
    ("browser_id", T.StringType()),
)

# Provider records, as DDL.
PAYPAL_PAYMENT = """
    id STRING, state STRING, create_time STRING,
    payer STRUCT<payer_info: STRUCT<
        email: STRING, first_name: STRING, last_name: STRING, country_code: STRING,
        billing_address: STRUCT<postal_code: STRING>>>,
    transactions ARRAY<STRUCT<
        amount: STRUCT<total: STRING, currency: STRING>, custom: STRING,
        item_list: STRUCT<shipping_address: STRUCT<postal_code: STRING>>,
        related_resources: ARRAY<STRUCT<authorization: STRUCT<id: STRING>>>>>,
    links ARRAY<STRUCT<href: STRING, rel: STRING, method: STRING>>
"""

STRIPE_CHARGE = """
    id STRING, amount BIGINT, currency STRING, created BIGINT, receipt_email STRING, balance_transaction STRING,
    source STRUCT<country: STRING>
"""

STRIPE_EVENT = "id STRING, data STRUCT<object: STRUCT<id: STRING, balance_transaction: STRING>>"

BALANCE_TRANSACTION = "id STRING, amount BIGINT"

IDENTITY_USER = """
    user STRUCT<primaryEmailAddress: STRING, privateFields: STRUCT<firstName: STRING, secondName: STRING>>
"""

GOAL_SHEET = "sheets STRUCT<Sheet1: ARRAY<STRUCT<total: DOUBLE, goal: DOUBLE>>>"

"""Checkout requests, PayPal return URLs and landing URLs.

Producers put the name of their analytics tool in front of the page view, browser and visit ids. ``id_prefix`` is that
name: with ``id_prefix="site"`` the fields are ``sitePageviewId``, ``siteBrowserId`` and ``siteVisitId``.

``sources`` lists the acquisition sources a site knows by member name, and is not checked if it is not given; component
types have a default.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions import urls
from donorlake.functions.documents import Field, member_of, one_of, read_documents
from donorlake.functions.stages import computed_once
from donorlake.sources.kinds import read_by_kind

_TEST = "struct<name:string,variant:string>"
_TESTS = f"array<{_TEST}>"

# A test entry needs both its name and its variant.
_NAMED = "CASE WHEN {v}.name IS NOT NULL AND {v}.variant IS NOT NULL THEN {v} END"
_ALL_NAMED = (
    "CASE WHEN forall({v}, t -> t.name IS NOT NULL AND t.variant IS NOT NULL) THEN array_distinct({v}) END"
)


def id_field(prefix: str, name: str) -> str:
    return f"{prefix}{name}" if prefix else name[0].lower() + name[1:]


def _acquisition_fields(sources: tuple[str, ...] | None, component_types: tuple[str, ...]) -> list[Field]:
    return [
        Field("component_id", "$.componentId", required=False),
        Field("component_type", "$.componentType", required=False, then=member_of(component_types)),
        Field("source", "$.source", required=False, then=member_of(sources)),
        Field("referrer_test", "$.refererAbTest", _TEST, required=False, then=_NAMED),
        Field("native_tests", "$.nativeAbTests", _TESTS, required=False, then=_ALL_NAMED),
    ]


def _referrer_fields() -> list[Field]:
    return [
        Field("referrer_pageview_id", "$.refererPageviewId", required=False),
        Field("referrer_url", "$.refererUrl", required=False),
    ]


def read_card_requests(
    raw: DataFrame,
    document: str = "document",
    id_prefix: str = "",
    sources: tuple[str, ...] | None = None,
    component_types: tuple[str, ...] = fixed.COMPONENT_TYPES,
    asked: Collection[str] | None = None,
) -> DataFrame:
    """Card checkout submissions. The card token is checked for presence and not kept."""
    fields = [
        Field("name", "$.name"),
        Field("currency", "$.currency", then=one_of({c: c for c in fixed.KNOWN_CURRENCIES}, of="upper({v})")),
        Field("amount", "$.amount", "number"),
        Field("email", "$.email"),
        Field("token", "$.token"),
        Field("postcode", "$.postcode", required=False),
        Field("pageview_id", f"$.{id_field(id_prefix, 'PageviewId')}"),
        Field("browser_id", f"$.{id_field(id_prefix, 'BrowserId')}", required=False),
        Field("cmp", "$.cmp", required=False),
        Field("intcmp", "$.intcmp", required=False),
        *_referrer_fields(),
        Field("iduser", "$.idUser", required=False),
        Field("platform", "$.platform", required=False),
        Field("visit_id", f"$.{id_field(id_prefix, 'VisitId')}", required=False),
        *_acquisition_fields(sources, component_types),
        Field("is_support", "$.isSupport", "flag", required=False),
    ]
    return read_documents(raw, document, fields, asked).drop("token")


def read_auth_requests(
    raw: DataFrame,
    document: str = "document",
    id_prefix: str = "",
    sources: tuple[str, ...] | None = None,
    component_types: tuple[str, ...] = fixed.COMPONENT_TYPES,
) -> DataFrame:
    """PayPal authorisation requests: at least 1, referrer URL without its fragment."""
    fields = [
        Field("country_group", "$.countryGroup", then=one_of({g: g for g in fixed.COUNTRY_GROUP_PATH})),
        Field("amount", "$.amount", "number", then="CASE WHEN {v} >= 1 THEN {v} END"),
        Field("cmp", "$.cmp", required=False),
        Field("intcmp", "$.intCmp", required=False),
        *_referrer_fields(),
        Field("pageview_id", f"$.{id_field(id_prefix, 'PageviewId')}", required=False),
        Field("browser_id", f"$.{id_field(id_prefix, 'BrowserId')}", required=False),
        Field("visit_id", f"$.{id_field(id_prefix, 'VisitId')}", required=False),
        Field("is_support", "$.supportRedirect", "flag", required=False),
        *_acquisition_fields(sources, component_types),
        Field("deprecated_test", "$.abTest", _TEST, required=False, then=_NAMED),
    ]
    parsed = read_documents(raw, document, fields).drop("deprecated_test")
    return parsed.withColumn("referrer_url", urls.without_fragment(F.col("referrer_url")))


def read_capture_requests(
    raw: DataFrame,
    document: str = "document",
    id_prefix: str = "",
    sources: tuple[str, ...] | None = None,
    component_types: tuple[str, ...] = fixed.COMPONENT_TYPES,
    asked: Collection[str] | None = None,
) -> DataFrame:
    """PayPal mobile capture requests. The deprecated ``abTest`` is checked but never used."""
    fields = [
        Field("paymentid", "$.paymentId"),
        Field("platform", "$.platform"),
        Field("iduser", "$.idUser", required=False),
        Field("cmp", "$.cmp", required=False),
        Field("intcmp", "$.intCmp", required=False),
        *_referrer_fields(),
        Field("pageview_id", f"$.{id_field(id_prefix, 'PageviewId')}", required=False),
        Field("browser_id", f"$.{id_field(id_prefix, 'BrowserId')}", required=False),
        Field("deprecated_test", "$.abTest", _TEST, required=False, then=_NAMED),
        *_acquisition_fields(sources, component_types),
    ]
    return read_documents(raw, document, fields, asked).drop("deprecated_test")


def read_return_urls(
    log: DataFrame,
    url: str = "url",
    id_prefix: str = "",
    sources: tuple[str, ...] | None = None,
    component_types: tuple[str, ...] = fixed.COMPONENT_TYPES,
    asked: Collection[str] | None = None,
) -> DataFrame:
    """PayPal return URLs. ``paymentId``, ``token`` and ``PayerID`` are required; a bad optional value also rejects."""
    value = urls.pair_value
    raw = {
        "paymentid": value("paymentId"),
        "_token": value("token"),
        "payer_id": value("PayerID"),
        "cmp": value("CMP"),
        "intcmp": value("INTCMP"),
        "referrer_pageview_id": value("refererPageviewId"),
        "referrer_url": value("refererUrl"),
        "pageview_id": value("pvid"),
        "browser_id": value("bid"),
        "visit_id": value(id_field(id_prefix, "VisitId")),
        "component_id": value("componentId"),
        "_component_type": value("componentType"),
        "_source": value("source"),
        "_referrer_test": value("refererAbTest"),
        "_native_tests": value("nativeAbTests"),
        "_is_support": value("supportRedirect"),
    }
    read = {
        "component_type": member_of(component_types).format(v="_component_type"),
        "source": member_of(sources).format(v="_source"),
        "_test": f"from_json(_referrer_test, '{_TEST}')",
        "_tests": f"from_json(_native_tests, '{_TESTS}')",
        "is_support": "CASE _is_support WHEN 'true' THEN true WHEN 'false' THEN false END",
    }
    checked = {"referrer_test": _NAMED.format(v="_test"), "native_tests": _ALL_NAMED.format(v="_tests")}
    required = {"paymentid": "paymentId", "_token": "token", "payer_id": "PayerID"}
    optional = ["component_type", "source", "referrer_test", "native_tests", "is_support"]
    faults = [f"WHEN {c} IS NULL THEN '{key}'" for c, key in required.items()]
    faults += [f"WHEN _{c} IS NOT NULL AND {c} IS NULL THEN '{c}'" for c in optional]

    if asked is not None:
        unasked = [c for c in raw if c not in asked and c not in required and not c.startswith("_")]
        raw |= dict.fromkeys(unasked, "CAST(NULL AS STRING)")
    parsed = log.withColumn("_pairs", urls.query_pairs(F.col(url)))
    for stage in (raw, read, checked):
        parsed = parsed.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage.items()])
    names = [c for c in [*raw, *read, *checked] if not c.startswith("_")]
    problem = F.expr(f"CASE {' '.join(faults)} END")
    return computed_once(parsed, {**{c: F.col(c) for c in names}, "problem": problem}, keep=log.columns)


def read_requests(
    log: DataFrame,
    id_prefix: str = "",
    sources: tuple[str, ...] | None = None,
    component_types: tuple[str, ...] = fixed.COMPONENT_TYPES,
    asked: Collection[str] | None = None,
) -> DataFrame:
    """The requests of all payment sources from one log, read in one pass.

    ``kind`` is the payment source: stripe (a checkout form as JSON), paypal-execute (a return URL) or paypal-capture
    (JSON of the apps). What is known beside the document comes in columns: ``charge_id``, the charge a form led to,
    and ``session_platform`` and ``session_iduser`` of who came back. ``paymentid`` is the payment a request is for.

    A job that needs few of the columns names them in ``asked``: every field is checked all the same, but texts that are
    not named are not read and come as null.
    """
    options = {"id_prefix": id_prefix, "sources": sources, "component_types": component_types}
    options["asked"] = asked if asked is None else {"paymentid", *asked}
    readers = {
        "stripe": lambda df, text: read_card_requests(df, text, **options),
        "paypal-execute": lambda df, text: read_return_urls(df, text, **options),
        "paypal-capture": lambda df, text: read_capture_requests(df, text, **options),
    }
    read = read_by_kind(log, readers)
    return read.withColumns(
        {
            "paymentid": F.coalesce("charge_id", "paymentid"),
            "platform": F.coalesce("platform", "session_platform"),
            "iduser": F.coalesce("iduser", "session_iduser"),
        }
    ).drop("charge_id", "session_platform", "session_iduser")


def read_landing_urls(
    log: DataFrame,
    url: str = "url",
    sources: tuple[str, ...] | None = None,
    component_types: tuple[str, ...] = fixed.COMPONENT_TYPES,
) -> DataFrame:
    """Landing URLs whose ``acquisitionData`` parameter carries the referrer's JSON. First value of the key counts."""
    fields = [
        Field("campaign_code", "$.campaignCode", required=False),
        Field("referrer_pageview_id", "$.referrerPageviewId", required=False),
        Field("referrer_url", "$.referrerUrl", required=False),
        Field("component_id", "$.componentId", required=False),
        Field("component_type", "$.componentType", required=False, then=member_of(component_types)),
        Field("source", "$.source", required=False, then=member_of(sources)),
        Field("ab_test", "$.abTest", _TEST, required=False, then=_NAMED),
    ]
    data = F.expr(urls.pair_value("acquisitionData"))
    log = log.withColumn("_pairs", urls.query_pairs(F.col(url))).withColumn("_data", data).drop("_pairs")
    parsed = read_documents(log, "_data", fields)
    return parsed.withColumn("problem", F.when(F.col("_data").isNull(), "not found").otherwise(F.col("problem"))).drop(
        "_data"
    )

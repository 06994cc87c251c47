"""Browser analytics: checkout funnel, purchases and visitor dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions import cookies, money, urls
from donorlake.functions.stages import computed_once
from donorlake.operators import folds


def with_consent(beacons: DataFrame) -> DataFrame:
    """Beacons of visitors who did not opt out, by browser setting or by cookie."""
    return beacons.where(~(F.col("do_not_track") | F.col("analytics_off")))


def first_steps(beacons: DataFrame) -> DataFrame:
    """The first beacon of each step on each page load."""
    return folds.first_write(beacons, ["pageview_id", "step"], ["ts", "event_id"])


def step_keys(beacons: DataFrame) -> DataFrame:
    """One row per counted step: steps 1 to 3 once per page load, step 4 each time the page is shown."""
    once = F.col("step").isin(*fixed.ONCE_PER_PAGE_STEPS)
    return beacons.groupBy("platform", "pageview_id", "step").agg(
        F.when(once, F.lit(1)).otherwise(F.count("*")).cast("bigint").alias("n")
    )


def funnel(beacons: DataFrame) -> DataFrame:
    """Steps per platform with the share of starters who reached each.

    A page load and step is one row after the map-side fold, so a page that repeats a step costs nothing extra.
    """
    return funnel_of_steps(step_keys(beacons))


def funnel_of_steps(steps_seen: DataFrame) -> DataFrame:
    steps = {n: F.coalesce(F.sum(F.when(F.col("step") == n, F.col("n"))), F.lit(0)) for n in fixed.CHECKOUT_STEPS}
    table = steps_seen.groupBy("platform").agg(*[c.alias(f"step_{n}") for n, c in steps.items()])
    share = lambda n: F.try_divide(F.col(f"step_{n}").cast("double"), F.col("step_1").cast("double"))
    return table.withColumns({f"rate_{n}": share(n) for n in steps if n > 1})


def revenue(purchases: DataFrame) -> DataFrame:
    """Purchases by upper-cased currency."""
    return purchases.groupBy(F.upper("currency").alias("currency")).agg(
        F.count("*").alias("n"), F.sum("price").alias("total")
    )


def revenue_gap(purchases: DataFrame, ledger: DataFrame) -> DataFrame:
    """Purchases as browsers report them against money that was paid.

    PayPal beacons fire when the payer is sent off to approve, so browsers report more than arrives.
    """
    reported = revenue(purchases).select("currency", F.col("n").alias("beacons"), F.col("total").alias("reported"))
    paid = (
        ledger.where(F.col("status") == "Paid")
        .groupBy("currency")
        .agg(F.count("*").alias("payments"), F.sum("amount").alias("paid"))
    )
    return reported.join(paid, "currency", "full")


def last_contribution(contributions: DataFrame) -> DataFrame:
    """Per browser the creation time that was written last, which need not be the latest one."""
    return contributions.groupBy("browser_id").agg(
        F.max_by("created", F.struct("received_at", "delivery_id")).alias("last_contribution"),
        F.count("*").alias("n_contributions"),
    )


def progress(totals: DataFrame, goals: DataFrame) -> DataFrame:
    """Progress bars: what a campaign has raised against its goal."""
    raised = F.coalesce(F.col("raised"), F.lit(0).cast("decimal(18,2)"))
    return goals.join(totals, "campaign", "left").select(
        "campaign",
        money.display_amount(raised).alias("raised"),
        "goal",
        money.progress_shift(raised, F.col("goal")).alias("shift_percent"),
        (F.col("goal") / 1000).alias("goal_thousands"),
        money.progress_shift(F.col("sheet_total"), F.col("goal")).alias("sheet_shift_percent"),
    )


def visitor_dimensions(
    requests: DataFrame, user_cookie: str, signed_out_cookie: str, url: str, pageview: str, browser_cookie: str, charge: str
) -> DataFrame:
    """What analytics knows of a visitor, from their cookies, the page and its URL.

    The page-view id is there if the analytics tool ran, the charge if the page shows a payment.
    """
    used = (user_cookie, signed_out_cookie, url, pageview, browser_cookie, charge)
    campaign = F.regexp_extract(url, r"^[^?#]*\?[^#]*?INTCMP=([^&#]*)", 1)
    signed_in: Column = F.col("_user.id").isNotNull()
    return computed_once(requests, {"_user": cookies.cookie_user(F.col(user_cookie))}).select(
        *[c for c in requests.columns if c not in used],
        signed_in.alias("signed_in"),
        (F.col(signed_out_cookie).isNotNull() & ~signed_in).alias("signed_out"),
        F.lit(fixed.ANALYTICS_PLATFORM).alias("platform"),
        F.col("_user.id").alias("identity_id"),
        F.col("_user.display_name").alias("display_name"),
        F.col(pageview).alias("pageview_id"),
        F.nullif(F.col(browser_cookie), F.lit("")).alias("browser_id"),
        F.col(charge).alias("charge_id"),
        F.nullif(campaign, F.lit("")).alias("intcmp"),
    )


def landing(parsed: DataFrame, url: str = "url") -> DataFrame:
    """Landing log with the referrer's data and the campaign of the page itself."""
    return parsed.withColumns(
        {
            "outcome": F.when(F.col("problem").isNull(), "ok").otherwise(F.col("problem")),
            "referrer_url": urls.without_fragment(F.col("referrer_url")),
            "referrer_is_external": urls.is_external(F.col("referrer_url")),
            "query_page": urls.url_parameter(F.col(url), "page"),
            "query_utm": urls.url_parameter(F.col(url), "utm_source"),
        }
    )

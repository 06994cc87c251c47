"""Request-log jobs: tags, platform, routing, profiles and test users."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from donorlake import fixed_values as fixed
from donorlake.functions import money
from donorlake.functions.text import look_up, salted_hash
from donorlake.operators import lookups, running


@dataclass(frozen=True)
class LogTag:
    name: str
    value: Column
    hashed: bool = False


def request_tags(requests: DataFrame, tags: Sequence[LogTag], salt: str) -> DataFrame:
    """Tags of a request; a missing one is "unknown"."""
    tag = lambda t: F.coalesce(salted_hash(t.value, salt) if t.hashed else t.value, F.lit("unknown"))
    return requests.withColumns({t.name: tag(t) for t in tags})


def session_platform(
    requests: DataFrame, session: str, order: Sequence[str], chunk: Column, body: str = "body_platform", query: str = "query_platform"
) -> DataFrame:
    """Platform of each request: its own, else the one the session remembers, else the web."""
    own = requests.withColumn("_own", F.coalesce(body, query))
    carried = running.carry_forward(own, session, order, "_own", chunk, "platform")
    platform = F.coalesce("platform", F.lit(fixed.DEFAULT_PLATFORM))
    return (
        carried.withColumn("platform", platform)
        .withColumn("is_mobile", F.col("platform").isin(*fixed.MOBILE_PLATFORMS))
        .drop("_own")
    )


def country_group_path(group: Column) -> Column:
    return F.coalesce(look_up(group, fixed.COUNTRY_GROUP_PATH), F.lit(fixed.DEFAULT_COUNTRY_GROUP))


def card_country_group(currency: Column) -> Column:
    return look_up(currency, fixed.CARD_COUNTRY_GROUP, fixed.DEFAULT_COUNTRY_GROUP)


def route(requests: DataFrame, countries: DataFrame) -> DataFrame:
    """Requests with the country group, path and service of their country; an unknown country falls back."""
    known = countries.select("country_code", F.col("country_group").alias("_group"))
    routed = requests.join(known, "country_code", "left")
    return routed.withColumns(
        {
            "path": country_group_path(F.col("_group")),
            "country_group": F.coalesce("_group", F.lit(fixed.DEFAULT_COUNTRY_GROUP)),
            "is_fallback": F.col("_group").isNull(),
        }
    ).drop("_group")


def routing_report(requests: DataFrame, countries: DataFrame) -> DataFrame:
    """Requests per path. They are counted per country code first, so the join sees countries and not requests."""
    per_code = requests.groupBy("country_code").agg(F.count("*").alias("n"))
    return route(per_code, countries).groupBy("path", "country_group", "is_fallback").agg(F.sum("n").alias("n"))


def enrich_visitors(requests: DataFrame, profiles: DataFrame, user: str) -> DataFrame:
    """Signed-in visitors with their profile; without one, both fields stay null.

    Requests are folded to one row per visitor before the join, so a visitor with very many requests is one row.
    """
    visitors = requests.where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n_requests"))
    return visitors.join(profiles, user, "left")


def enrich_requests(requests: DataFrame, profiles: DataFrame, user: str, row_id: str) -> DataFrame:
    """Every request with its visitor's profile, null without one."""
    found = profiles.withColumnRenamed(user, "_profile")
    return lookups.look_up_left(requests, found, F.col(user), "_profile", F.col(row_id))


def first_word(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def mode_report(payments: DataFrame, test_users: DataFrame) -> DataFrame:
    """Payments of test users and of real ones, told apart by the first word of the name given."""
    per_word = payments.groupBy(first_word(F.col("name")).alias("user_name")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("total")
    )
    flagged = per_word.join(test_users.select("user_name", F.lit(True).alias("_test")).distinct(), "user_name", "left")
    mode = F.when(F.col("_test"), "Testing").otherwise("Default")
    return flagged.groupBy(mode.alias("mode")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def split_by_mode(payments: DataFrame, test_users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(real, test): every payment is in exactly one of the two."""
    named = payments.withColumn("user_name", first_word(F.col("name")))
    users = test_users.select("user_name").where(F.col("user_name").isNotNull())
    real = named.join(users, "user_name", "left_anti").drop("user_name")
    test = named.join(users, "user_name", "left_semi").drop("user_name")
    return real, test


def request_test_user(query: Column, cookie: Column, profile_name: Column) -> Column:
    """Test-user name of a request: from the query, else the cookie, else the profile."""
    return F.coalesce(query, cookie, profile_name)


def request_mode_report(requests: DataFrame, query: str, cookie: str, profile_name: str, test_users: DataFrame) -> DataFrame:
    """Requests of test users and of others. They are counted per name first, so the join sees names."""
    name = request_test_user(F.col(query), F.col(cookie), F.col(profile_name))
    per_name = requests.groupBy(name.alias("user_name")).agg(F.count("*").alias("n"))
    flagged = per_name.join(test_users.select("user_name", F.lit(True).alias("_test")).distinct(), "user_name", "left")
    mode = F.when(F.col("_test"), "Testing").otherwise("Default")
    return flagged.groupBy(mode.alias("mode")).agg(F.sum("n").alias("n"))


def amount_caps(requests: DataFrame) -> DataFrame:
    """What each path would charge for the amount asked for."""
    known = money.known_currency(F.col("currency"))
    return requests.withColumns(
        {
            "known_currency": known,
            "paypal_accepted": known.isNotNull() & (F.col("amount") >= 1),
            "paypal_amount": money.capped_paypal_amount(F.col("amount"), known),
            "stripe_minor": money.capped_stripe_minor(F.col("amount"), known),
            "card_group": card_country_group(known),
        }
    )


def state_accepted(state: Column, path: Column) -> Column:
    """An executed payment must be approved, a captured one completed, in any case."""
    wanted = F.when(path == "execute", "APPROVED").otherwise("COMPLETED")
    return F.upper(state) == wanted

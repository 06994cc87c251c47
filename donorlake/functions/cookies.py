"""Values that arrive inside cookies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from donorlake.functions.urls import decoded


def cookie_fields(cookie: Column) -> Column:
    """JSON array in a signed cookie: the part before the first dot, in the URL-safe base64 alphabet."""
    payload = F.translate(F.split_part(cookie, F.lit("."), F.lit(1)), "-_,", "+/=")
    # A value that is not base64, or not UTF-8 once decoded, is an empty cookie.
    text = F.try_validate_utf8(F.try_to_binary(payload, F.lit("base64")).cast("string"))
    return F.from_json(text, "array<string>")


def cookie_user(cookie: Column) -> Column:
    fields = cookie_fields(cookie)
    return F.struct(
        F.try_element_at(fields, F.lit(1)).alias("id"),
        decoded(F.try_element_at(fields, F.lit(3))).alias("display_name"),
        F.try_element_at(fields, F.lit(7)).alias("account_created"),
        F.try_element_at(fields, F.lit(8)).alias("email_verified"),
    )

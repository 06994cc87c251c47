"""Names, slugs, enum texts and other small text rules."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F


def look_up(key: Column, table: Mapping[Any, Any], default: Any = None) -> Column:
    """A small fixed table as a ``when`` chain: no join, stays inside generated code."""
    if not table:
        return F.lit(default)
    pairs = list(table.items())
    chain = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), pairs[1:], F.when(key == pairs[0][0], F.lit(pairs[0][1])))
    return chain.otherwise(F.lit(default))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    """The present parts joined by a space; null if there are none."""
    return F.when(first.isNotNull() | last.isNotNull(), F.concat_ws(" ", first, last))


def display_name(first: Column, second: Column) -> Column:
    """Both parts or nothing."""
    return F.concat(first, F.lit(" "), second)


def slug(text: Column) -> Column:
    """Lower-case words joined by single hyphens."""
    words = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(words, "^-+|-+$", "")


def encode_enum(member: Column) -> Column:
    """``AcquisitionsEpic`` -> ``ACQUISITIONS_EPIC``."""
    return F.upper(F.regexp_replace(member, "(?<!^)([A-Z])", "_$1"))


def decode_enum(text: Column, members: tuple[str, ...]) -> Column:
    """``ACQUISITIONS_EPIC`` -> ``AcquisitionsEpic``: underscores and case do not count; unknown -> null."""
    return look_up(F.lower(F.replace(text, F.lit("_"), F.lit(""))), {m.lower(): m for m in members})


# What a browser takes for white space.
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def remove_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE}+", "")


def browser_length(text: Column) -> Column:
    """Length as a browser counts it: UTF-16 units, two for a character outside the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def salted_hash(text: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), text), 256)


UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_text(text: Column) -> Column:
    """Lower-case id, or null if it is not one."""
    low = F.lower(text)
    return F.when(low.rlike(UUID_PATTERN), low)


def paypal_error_type(name: Column) -> Column:
    from donorlake.fixed_values import PAYPAL_ERROR_TYPE

    return look_up(name, PAYPAL_ERROR_TYPE, "Other")


def paypal_error_message(message: Column) -> Column:
    from donorlake.fixed_values import BLANK_ERROR_MESSAGE

    return F.coalesce(blank_to_null(message), F.lit(BLANK_ERROR_MESSAGE))

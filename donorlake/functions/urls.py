"""URL rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def query_pairs(url: Column) -> Column:
    """The ``key=value`` pieces of a URL's query, split once so that each parameter is a cheap array look-up."""
    return F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")


def decoded(value: Column) -> Column:
    """Percent-decoded text (``+`` is a space); null if it is not decodable."""
    return F.try_url_decode(value)


def pair_value(key: str, pairs: str = "_pairs") -> str:
    """SQL for the first value of a query key, decoded; null if the key is absent."""
    first = f"try_element_at(filter({pairs}, p -> p = '{key}' OR startswith(p, '{key}=')), 1)"
    return f"try_url_decode(substring({first}, {len(key) + 2}))"


def url_parameter(url: Column, key: str) -> Column:
    """First value of a query key, decoded: absent -> null, no value -> ``""``."""
    named = F.filter(query_pairs(url), lambda pair: (pair == key) | pair.startswith(f"{key}="))
    return decoded(F.substr(F.get(named, F.lit(0)), F.lit(len(key) + 2)))


def without_fragment(url: Column) -> Column:
    """URL up to its fragment; null if it does not parse."""
    clean = F.regexp_replace(url, "#.*$", "")
    return F.when(F.try_parse_url(clean, F.lit("PATH")).isNotNull(), clean)


def is_external(url: Column) -> Column:
    """True if something other than an empty host is left in front of the first slash, schemes aside."""
    return url.rlike("^(https?://)*[^/]")

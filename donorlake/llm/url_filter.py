"""URL filters: pattern rules looked up by their rarest literal token.

A rule is a regular expression over host and path, together with the literal tokens that every address it matches must
hold. Rules are filed under the one of their tokens that fewest of the addresses hold. An address is cut into tokens,
the tokens fetch the rules filed under them, and only these run their regular expression. The file is a constant of the
plan (an array of buckets, reached by the token's checksum), so addresses are judged where they are read: no shuffle,
and an address or host that a third of all rows share is no hot key.

Null addresses and those without ``://`` have an empty host and path; no rule of a host fits them. Repeated rows are
judged one by one. Extra columns are kept; a column named like a result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.llm.common import fold_ascii

#: The file of rules travels with the plan; more rules than this are refused.
MAX_RULES = 2000

_TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``text`` is shown in results, ``regex`` is run on host and path, ``tokens`` must all occur in what it matches."""

    action: str
    text: str
    regex: str
    tokens: tuple[str, ...]


def place_rule(action: str, text: str) -> Rule:
    """``host/path``: the host or any of its subdomains, and a path that starts with the rule's.

    Whole tokens only count where the rule ends them: a path may go on after the rule's last character.
    """
    host, slash, path = text.partition("/")
    tokens = re.findall(_TOKEN, host) + re.findall(_TOKEN + r"(?=[^A-Za-z0-9])", slash + path)
    end = "" if slash else r"(?=/|\z)"
    return Rule(action, text, r"\A(?:[^/]*\.)?" + _quoted(host + slash + path) + end, tuple(t.lower() for t in tokens))


def word_rule(action: str, phrase: str) -> Rule:
    """A phrase anywhere in host or path, in any case, not as a part of longer words."""
    return Rule(
        action,
        phrase,
        "(?i)(?<![A-Za-z0-9])" + _quoted(phrase) + "(?![A-Za-z0-9])",
        tuple(t.lower() for t in re.findall(_TOKEN, phrase)),
    )


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


PLACES = (
    place_rule("allow", "com/"),
    place_rule("block", "example.com/en/"),
    place_rule("allow", "www.example.com/en/"),
    place_rule("block", "net/es/"),
    place_rule("block", "net/fr/"),
)
# What addresses of unwanted sites say of themselves.
PHRASES = tuple(
    word_rule("block", phrase)
    for phrase in (
        "adult",
        "porn",
        "xxx",
        "casino",
        "free-bets",
        "spam-farm",
        "cheap-pills",
        "viagra",
        "warez",
    )
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return fold_ascii(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold_ascii(address), r"[^a-z0-9]+"), lambda t: t != ""))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, int]:
    """How many rows hold each token of the rules. At most one row per token of a rule reaches the driver."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    host, path = split_url(F.col(url))
    held = pages.select(F.explode(F.array_intersect(_tokens(F.concat(host, path)), F.array(*map(F.lit, wanted)))).alias("token"))
    found = {row["token"]: row["n"] for row in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: found.get(t, 0) for t in wanted}


def _filed(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[list[list[tuple[str, int]]], list[int]]:
    """Buckets of (token, rule number), and the numbers of rules without a token, which every address has to run."""
    n = 1 << max(3, (2 * len(rules)).bit_length())
    buckets: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    everywhere = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
            buckets[zlib.crc32(token.encode()) % n].append((token, k))
        else:
            everywhere.append(k)
    return buckets, everywhere


def judge(pages: DataFrame, places: tuple[Rule, ...] = PLACES, phrases: tuple[Rule, ...] = PHRASES, url: str = "url") -> DataFrame:
    """All rows with ``host``, ``path``, ``rule``, ``verdict``, ``phrase`` and ``n_candidates``.

    ``rule`` is the longest place rule that fits, and its action is the verdict. Where none fits, a phrase decides
    (``phrase`` is the longest found), and an address without either is allowed. Ties go to the smaller text.
    """
    rules = (*places, *phrases)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the file of rules holds {MAX_RULES}")
    buckets, everywhere = _filed(rules, token_counts(pages, rules, url))

    def literal(token: str, k: int) -> Column:
        rule = rules[k]
        fields = {"token": token, "regex": rule.regex, "size": -len(rule.text), "text": rule.text, "action": rule.action, "place": k < len(places)}
        return F.struct(*[F.lit(v).alias(name) for name, v in fields.items()])

    kind = "array<struct<token:string,regex:string,size:int,text:string,action:string,place:boolean>>"
    file = F.array(*[F.array(*[literal(*entry) for entry in bucket]).cast(kind) for bucket in buckets])
    always = F.array(*[literal("", k) for k in everywhere]).cast(kind)
    host, path = split_url(F.col(url))
    step = pages.withColumns({"host": host, "path": path}).withColumns({"_address": F.concat("host", "path")})
    step = step.withColumns({"_tokens": _tokens(F.col("_address"))})

    def fetched(token: Column) -> Column:
        bucket = F.get(file, (F.crc32(token) % len(buckets)).cast("int"))
        return F.filter(bucket, lambda rule: rule["token"] == token)

    step = step.withColumns({"_candidates": F.concat(F.flatten(F.transform("_tokens", fetched)), always)})
    step = step.withColumns({"_fits": F.filter("_candidates", lambda rule: F.regexp_like("_address", rule["regex"]))})

    def best(place: bool) -> Column:
        fits = F.filter("_fits", lambda rule: rule["place"] == F.lit(place))
        ranked = F.transform(fits, lambda rule: F.struct(rule["size"].alias("size"), rule["text"].alias("text"), rule["action"].alias("action")))
        return F.array_min(ranked)

    step = step.withColumns({"_place": best(True), "_phrase": best(False)})
    return step.withColumns(
        {
            "rule": F.col("_place.text"),
            "phrase": F.col("_phrase.text"),
            "verdict": F.coalesce("_place.action", "_phrase.action", F.lit("allow")),
            "n_candidates": F.size("_candidates"),
        }
    ).drop("_address", "_tokens", "_candidates", "_fits", "_place", "_phrase")

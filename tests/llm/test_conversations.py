"""Conversation repair against a search over all edits, on the given tables, odd rows and conversations cut in pieces."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from donorlake.llm import conversation_repair as repair
from donorlake.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Rows are (initial, has to go, truncated). Tries every edit everywhere."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * len(rows) + 1000))

    @lru_cache(None)
    def best(at: int, state: str, added: int) -> tuple[float, str]:
        options: list[tuple[float, str]] = [(float("inf"), "")]

        def then(letter: str, cost: int, *there: object) -> None:
            rest = best(*there)
            options.append((rest[0] + cost, letter + rest[1]))

        if at == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if at < len(rows):
            initial, gone, short = rows[at]
            then("D", 4, at + 1, state, 0)
            if not gone:
                if (state, initial) in AFTER:
                    then("K", 3 * short, at + 1, AFTER[state, initial], 0)
                for role in "ua":
                    if (state, role) in AFTER:
                        then("R", 3 + 3 * short, at + 1, role, 0)
        if added < 4:
            for role in "ua":
                if (state, role) in AFTER:
                    then("I", 3, at, role, added + 1)
        return min(options)

    return best(0, "", 0)


def expected(table: list[tuple]) -> dict:
    """The whole contract, row by row."""
    damaged = defaultdict(list)
    for conv_id, turn, role, text in table:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        damaged[conv_id].extend([(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1))
    out = {}
    for conv_id, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            solid = text.strip(BLANKS)
            blank = not solid
            twice = not blank and (role, text) in seen
            short = not blank and not twice and solid[-1] not in ".!?"
            seen.add((role, text))
            counts = [c + k for c, k in zip(counts, (blank, twice, short), strict=True)]
            marks.append((role[:1] or "-", blank or twice, short))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(marks)
        lines, state, left = [], "", iter(rows)
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            state = AFTER[state, row[1][:1]] if letter == "K" else "a" if state == "u" else "u"
            lines.append(f"{row[1] if letter == 'K' else NAMES[state]}:{row[2] if row else ''}")
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv_id] = (gaps, *counts, illegal, int(cost), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df) -> dict:
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, part int, key string, n int"


def odd() -> list[tuple]:
    rows = [(None, None, None, None), (None, 3, "user", "So."), (1, None, None, "x"), (1, 2, "assistant", " \n"), (2, 1, "", "Ho!")]
    rows += [(3, t, role, "Same.") for t in range(4) for role in ("user", "assistant", "system", "tool")]
    rows += [(4, 1, "user", "twice.")] * 5 + [(4, 2, "assistant", "yes")] * 3 + [(5, None, "user", "a."), (5, None, "assistant", "b.")]
    rows += [(6, 7, "system", "Only.")] + [(k, 0, "user", "Is it? ") for k in range(100, 160)] + [(7, -4, "users", "é. ")]
    return rows


def long_one(n: int = 600) -> list[tuple]:
    chosen = random.Random(5)
    texts = [f"{w}{end}" for w in ("yes", "no", "well", "so it is") for end in (".", "", "!", "?", " ")] + ["", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool"]
    return [(9, t // 2, chosen.choice(roles), chosen.choice(texts) + str(chosen.choice([t, 1])) * chosen.randint(0, 1)) for t in range(n)]


def test_tables_give_the_cheapest_and_least_edits():
    chosen = random.Random(2)
    for _ in range(1500):
        symbols = [chosen.choice([0, 2, 4, 6, 1, 3, 5, 7, 8, 2, 4]) for _ in range(chosen.randint(0, 13))]
        live = bytes(s for s in symbols if s != repair.GONE)
        edits, state = repair.edits_of(live)
        each = iter(edits)
        audit = "".join("D" if s == repair.GONE else next(each) for s in symbols) + repair.LAST[state]
        marks = [("sua-"[s // 2] if s < 8 else "u", s == 8, s < 8 and s % 2 == 1) for s in symbols]
        assert audit == cheapest(marks)[1]


def test_the_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = expected(rows)
    got = found(QUERIES["op11_conversation_repair"](spark, DIR))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: wanted.get(c, nothing) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("merge", ["true", "false"])
def test_odd_rows_and_a_conversation_over_many_ranges(spark, merge):
    rows = odd() + long_one()
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    try:
        got = found(repair.damaged_and_repaired(table))
        if merge == "false":
            assert len({part for part, _ in repair.repair(repair.damage(table)).places}) > 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    wanted = expected(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: wanted.get(c, nothing) for c in {r[0] for r in rows}}


def test_rows_that_stay_alternate(spark):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in odd()], SCHEMA)
    by = defaultdict(list)
    for r in repair.repair(table).rows().orderBy("conv_id", "part", "at").collect():
        by[r.conv_id].append(r.role[:1])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in by.values())


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damaged_and_repaired(empty).count() == 0

"""Personal data on long texts with many matches, added spans and redaction."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from donorlake.llm import personal_data as pd

from .helpers import frame, odd_rows

EVERY = pd.Model((0.0,) * 4, ((),) * 4, (-1.0,) * 4)


def busy(n: int, seed: int = 3) -> str:
    chosen = random.Random(seed)
    make = [
        lambda: ".".join(str(chosen.randint(0, 300)) for _ in range(chosen.choice([4, 4, 4, 6]))),
        lambda: f"{chosen.choice('abc')}{chosen.choice(['@', ' (at) ', '@'])}host{chosen.choice(['.org', ''])}",
        lambda: "".join(str(chosen.randint(0, 9)) + chosen.choice(["", "", " ", "-", "."]) for _ in range(chosen.randint(10, 20))),
        lambda: f"+{chosen.randint(1, 99)} ({chosen.randint(10, 99)}) {chosen.randint(10**5, 10**8)}",
        lambda: chosen.choice(["é", "call", "\n", "ß:", "mail"]),
    ]
    return " ".join(chosen.choice(make)() for _ in range(n))


def test_all_candidates_that_touch_no_base_span_of_their_kind(spark):
    texts = [(k, busy(n, k), "en", "s") for k, n in enumerate((0, 1, 2, 5, 40, 400))]
    found = pd.spans(frame(spark, odd_rows() + texts))
    rows = found.join(pd.chosen(found, EVERY).select("doc_id", "text", "_added"), ["doc_id", "text"]).collect()
    added = 0
    for r in rows:
        loose = [c for c in r._candidates if not c.strict]
        free = [c for c in loose if not any(b.kind == c.kind and b.s < c.e and c.s < b.e for b in r._base)]
        assert [tuple(a) for a in r._added] == sorted((c.s, c.kind, c.e) for c in free)
        added += len(free)
        for c in r._candidates:
            assert r.text[c.s : c.e].strip() == r.text[c.s : c.e] != ""
    assert added > 50


def test_both_ways_to_redact_agree(spark, monkeypatch):
    docs = frame(spark, odd_rows() + [(90 + k, busy(n, k), "en", "s") for k, n in enumerate((1, 3, 30, 300))])
    found = []
    for few in (10_000, 0):
        monkeypatch.setattr(pd, "FEW", few)
        found.append(sorted(map(repr, pd.redact(docs).collect())))
    assert found[0] == found[1] and any("<ip>" in row for row in found[0])


def test_spans_that_overlap_are_replaced_under_the_first(spark):
    text = "a@1.2.3.4 and +1.2.3.4567890 or 4111 1111 1111 1111."
    (row,) = pd.redact(frame(spark, [(1, text, "en", "s")])).collect()
    (many,) = pd.redact(frame(spark, [(1, " ".join([text] * 40), "en", "s")])).collect()
    assert many.text == " ".join([row.text] * 40) and "<email>" in row.text and "<card>" in row.text


def test_what_looks_and_stands_like_confirmed_spans_is_added(spark):
    rows = [(k, f"You can send mail to person{k}@host{k}.org at any time.", "en", "s") for k in range(300)]
    rows += [(1000 + k, f"You can send mail to person{k} (at) host{k}.org at any time.", "en", "s") for k in range(6)]
    # Every other number of this form fails its check, so none is added.
    rows += [(2000 + k, f"The order of today was {4111111111111111 + k % 2} as sent.", "en", "s") for k in range(200)]
    got = {r.doc_id: r for r in pd.find(frame(spark, rows)).collect()}
    for k in range(6):
        text = next(t for i, t, _, _ in rows if i == 1000 + k)
        assert got[1000 + k].spans == f"email:{text.index('person')}:{text.index(' at any')}" and got[1000 + k].n_added == 1
        assert got[1000 + k].n_email == 0
    assert all(got[i].n_added == 0 for i in got if not 1000 <= i < 2000)


@pytest.mark.parametrize("kind", ["log"])
def test_long_logs_take_time_in_proportion(spark, kind):
    def log(n):
        return " ".join(f"10.{k % 250}.{k // 250 % 250}.7" for k in range(n))

    docs = frame(spark, [(n, log(n), "en", "s") for n in (10, 20_000, 160_000)]).select("doc_id", "text").repartition(1).cache()
    assert docs.count() == 3
    sizes = pd.chosen(pd.spans(docs), EVERY).select("doc_id", F.size("_base").alias("n"))
    took = {}
    for n in (10, 20_000, 160_000):
        started = time.perf_counter()
        assert sizes.filter(F.col("doc_id") == n).first().n == n
        took[n] = time.perf_counter() - started
    assert took[160_000] < 12 * max(took[20_000], 2)

"""Decontamination against a plain search, on odd rows and items, with broadcast and shuffled windows, and what is cleaned."""

from __future__ import annotations

import hashlib
import re
import time

import pytest

from donorlake.llm import decontaminate

from .helpers import PROSE, SCHEMA, frame, odd_rows

ITEMS = "item_id long, text string, words string, found int"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: str | None) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words: list[str], item: list[str]) -> set[int]:
    """Where any window of the item covers the words."""
    n = min(10, len(item))
    windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
    return {k + j for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for j in range(n)}


def expected(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    rows = []
    for doc_id, text in docs:
        words = normal(text)
        hit, names = set(), set()
        for item_id, item in items:
            if some := places(words, normal(item)):
                hit |= some
                names.add("" if item_id is None else str(item_id))
        named = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        rows.append((doc_id, len(words), len(hit), len(names), named, bool(hit)))
    return sorted(rows, key=repr)


def odd_items() -> list[tuple]:
    middle = " ".join(PROSE.split()[12:40])
    return [(1, middle), (2, middle.upper()), (2, middle), (30, "Stream ran; past THE old mill"), (4, "one, two"), (5, "two"), (None, "another text"), (7, None), (8, "--"), (9, "été Übermaß ß")]


def more_docs() -> list[tuple]:
    middle = " ".join(PROSE.split()[12:40])
    texts = [f"{middle} {middle}", middle.replace(" ", "--\n"), middle.replace("a", "A"), " ".join(middle.split()[:9]), " ".join(middle.split()[:10])]
    texts += ["Été übermaß ß", "été Übermaß ß", "ONE (two) one two two", f"x {' '.join(middle.split()[3:16])} y", "two" * 20_000 + " two"]
    return [(200 + k, t, "en", "z") for k, t in enumerate(texts)]


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, 0])
def test_against_a_plain_search(spark, monkeypatch, broadcast_bytes):
    whole = decontaminate.index
    monkeypatch.setattr(decontaminate, "index", lambda items, text: whole(items, text, broadcast_bytes=broadcast_bytes))
    docs = odd_rows() + more_docs()
    items = spark.createDataFrame([(i, t, "w", 1) for i, t in odd_items()], ITEMS)
    got = decontaminate.judge(frame(spark, docs), items).collect()
    assert sorted(map(tuple, got), key=repr) == expected([r[:2] for r in docs], odd_items())


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FEWEST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    docs = odd_rows()[:8] + more_docs()[:9]
    items = spark.createDataFrame([(i, t, "w", 1) for i, t in odd_items()], ITEMS)
    got = decontaminate.judge(frame(spark, docs), items).collect()
    assert sorted(map(tuple, got), key=repr) == expected([r[:2] for r in docs], odd_items())


def test_no_documents_and_no_items(spark):
    items = spark.createDataFrame([(i, t, "w", 1) for i, t in odd_items()], ITEMS)
    assert decontaminate.judge(spark.createDataFrame([], SCHEMA), items).count() == 0
    for none in (items.limit(0), items.filter("item_id in (7, 8)")):
        got = decontaminate.judge(frame(spark, odd_rows()), none).collect()
        assert len(got) == len(odd_rows()) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
        assert decontaminate.clean(frame(spark, odd_rows()), none).count() == len(odd_rows())


def test_hit_words_go_and_the_rest_stays(spark):
    item = " ".join(f"w{k}" for k in range(12))
    texts = [f"Before, {item}! After -- it.", item, f"a {item} b {item.upper()} c.", "Nothing: here\n", None, f"{item} w0 w1 "]
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    items = spark.createDataFrame([(1, item, "w", 1)], ITEMS)
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {0: "Before! After -- it.", 1: "", 2: "a b c.", 3: "Nothing: here\n", 4: None, 5: " w0 w1 "}
    assert {r.n for r in got.collect()} == {7}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items, documents=True).collect()) == [3, 4]


def test_long_texts_take_time_in_proportion(spark):
    item = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, item, "w", 1)], ITEMS)
    took = []
    for n in (1_000, 20_000, 200_000):
        text = " ".join(f"v{k % 5000}" for k in range(n)) + f" {item}" * (n // 100)
        docs = frame(spark, [(1, text, "en", "s")])
        started = time.perf_counter()
        assert decontaminate.judge(docs, items).first().n_hit == 12 * (n // 100)
        took.append(time.perf_counter() - started)
    assert took[2] < 10 * max(took[1], 2)

"""Spelling variants against a comparison by deleted letters, on the given tables and on odd words."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from donorlake.llm import spelling
from donorlake.llm.queries import QUERIES

from .helpers import frame, odd_rows

DIR = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows: list[tuple]) -> Counter:
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 6 and n >= 5})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    same = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a != b and (a[same:] == b[same + 1 :] if len(a) < len(b) else len(a) == len(b) and a[same + 1 :] == b[same + 1 :])


def expected(n: Counter) -> set[tuple]:
    shells = defaultdict(set)
    for w in n:
        if len(w) < 1000:
            for k in range(len(w)):
                shells[w[:k] + w[k + 1 :]].add(w)
        shells[w].add(w)
    near = defaultdict(set)
    long = [w for w in n if len(w) >= 1000]
    for group in [*shells.values(), set(long)]:
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def test_the_given_tables(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    wanted = expected(counts(rows))
    got = QUERIES["op12_spelling_variants"](spark, DIR).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(wanted) > 1000
    assert {tuple(r) for r in got} == wanted
    assert sum(r.form is not None for r in got) > 10


def test_odd_rows_long_words_and_chains(spark):
    long = "ab" * 20_000
    rows = odd_rows()
    texts = ["kitten " * 130 + "kittten " * 26 + "kitttten " * 5, "Übermaß übermaß ÜBERMASS " * 5, f"{long} {long}c " * 5]
    texts += ["aaaaaa aaaaaaa aaaaab baaaaa abcdef fedcba abcdfe " * 6, "mittens " * 26 + "mitten " * 26 + "sitten " * 5]
    rows += [(100 + k, t, "en", "a") for k, t in enumerate(texts)] + [(None, "sixsix " * 7, "en", "a")]
    got = spelling.variants(spelling.frequent(spelling.occurrences(frame(spark, rows)))).collect()
    wanted = expected(counts([(r[0], r[1]) for r in rows]))
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
    assert max(len({r.form, r.root}) for r in got) == 2


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.occurrences(frame(spark, [])).count() == 0


@pytest.mark.parametrize("word", ["kittens", "übermut", "aaabbb", "zyxwvu"])
def test_every_word_one_edit_away_shares_a_signature(spark, word):
    letters = "aküz"
    made = {word[:k] + x + word[k:] for k in range(len(word) + 1) for x in letters}
    made |= {word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in ["", *letters]}
    made = {w for w in made if w != word and len(w) >= 6}
    words = spark.createDataFrame([(w, 5) for w in {word, *made}], "word string, n long")
    found = {r.other for r in spelling.near(words).filter(f"word = '{word}'").collect()}
    assert found == made

"""Results against brute force, exact round trips and held-out accuracy, on the small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlake.llm import language_model, mixing, ngram_join, packing, personal_data, toxicity
from donorlake.llm.oracle import ORACLE
from donorlake.llm.queries import QUERIES

from .helpers import PROSE, frame

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, lang FROM '{DIR}/documents.parquet' ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", ORACLE)
def test_sql_gives_the_same_rows(spark, name):
    with duckdb.connect() as con:
        for table in ("documents", "pages", "labels", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
        cursor = con.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        wanted = sorted(map(repr, cursor.fetchall()))
    found = sorted(repr(tuple(r)) for r in QUERIES[name](spark, DIR).select(*names).collect())
    assert found == wanted


def crc(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def test_language_of_held_out_documents(spark, documents):
    lang = {i: label for i, _, label in documents}
    rows = QUERIES["op2_language_id"](spark, DIR).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_of_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{DIR}/labels.parquet'").fetchall())
    rows = [r for r in QUERIES["op8_toxicity"](spark, DIR).collect() if r.doc_id in truth]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in rows if not truth[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    toxic = [r for r in rows if truth[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)


def test_length_alone_makes_no_text_toxic():
    where = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{where}/documents.parquet' JOIN '{where}/labels.parquet' USING (doc_id) ORDER BY 1").fetchall()
    learned = [r for r in rows if crc(r[0], 5)]
    model = toxicity.fit([t for _, t, _ in learned], [y for _, _, y in learned])
    held = [(t, y, model.score(t)) for i, t, y in rows if not crc(i, 5)]
    # A text that is taken for toxic by itself makes a longer one toxic with it, as it should.
    long = "\n".join(t for t, y, p in held if not y and p < 0.5)
    assert len(long) > 1_500_000
    for at in range(0, len(long) - 1_000_000, 100_000):
        assert model.score(long[at : at + 1_000_000]) < 0.5
    assert model.score(PROSE + "\n" + "nothing is known here. " * 50_000) < 0.1
    worst = max((t for t, y, _ in held if y), key=model.score)
    assert model.score(long[:1_000_000] + "\n" + worst) >= 0.5


def test_long_texts_are_learned_from_whole(spark, monkeypatch):
    texts = [(k, PROSE * (100 if k < 3 else 1), "en", "s") for k in range(8)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    found, marks = toxicity.sample(frame(spark, texts), labels, F.lit(True))
    assert sorted(map(len, found)) == sorted(len(t) for _, t, _, _ in texts) and sum(marks) == 4
    # Of texts that are too long together, the longest are left out.
    monkeypatch.setattr(toxicity, "LETTERS", 5 * len(PROSE))
    assert sorted(map(len, toxicity.sample(frame(spark, texts), labels, F.lit(True))[0])) == [len(PROSE)] * 5


def test_neighbours_against_brute_force(spark):
    got = duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in got]), np.array([r[1] for r in got], dtype=np.float64)
    found = defaultdict(list)
    for r in QUERIES["op3_nearest_neighbours"](spark, DIR).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, v in zip(ids, x, strict=True):
        if q % 100:
            continue
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        best = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - d[np.searchsorted(ids, i)]) < 1e-12 for _, i, s in mine)
        hits += len(set(best) & {i for _, i, _ in mine})
    assert hits >= 0.9 * 10 * len(found)


KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def sure(kind: int, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        doubled = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def base_spans(text: str) -> str:
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if sure(k, m[0]))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def test_personal_data_against_brute_force(spark, documents):
    odd = [
        (1, "ä a@b.c-d.e@f.g x@y z@q@r.s me@h..i a@b.c_d@e.f", "en", "s"),
        (2, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 4111 1111-1111 1111 4111111111111112 4111-1111-1111-1111-", "en", "s"),
        (3, "+1 (555) 010-9999. +49-30-1234567 + 1 +12 ++441234567890", "en", "s"),
        (4, None, "en", "s"),
    ]
    tables = [(frame(spark, odd), {i: t or "" for i, t, _, _ in odd})]
    tables.append((spark.read.parquet(f"{DIR}/documents.parquet"), {i: t for i, t, _ in documents}))
    for table, texts in tables:
        for r in personal_data.find(table).collect():
            wanted = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest(), (r.doc_id, wanted, r.spans)
            assert set(filter(None, wanted.split(","))) <= set(r.spans.split(","))
            assert [r[f"n_{k}"] for k in KINDS] == [wanted.count(k + ":") for k in KINDS]


def test_redaction_replaces_spans_and_nothing_else(spark):
    rows = [(1, "mail a.b@c.de or +1 555 010 9999!", "en", "s"), (2, "nothing here", "en", "s"), (3, None, "en", "s")]
    docs = frame(spark, rows)
    clean = personal_data.redact(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "mail <email> or <phone>!", 2: "nothing here", 3: None}


def test_added_spans_need_precision():
    n, good = np.full(10, 100), np.array([100, 100, 99, 60, 20, 0, 0, 0, 0, 0])
    p = np.linspace(5, -5, 10)
    assert personal_data.threshold(p, n, good, 0.95) == p[2]
    assert personal_data.threshold(p, n, np.zeros(10), 0.95) is None
    x = np.array([[0, 1], [1, 1], [2, 0], [3, 0]])
    _, trees, score = personal_data.boost(x, np.full(4, 50), np.array([0, 0, 50, 50]))
    assert trees and (score > 0).tolist() == [False, False, True, True]


def brute_components(texts: dict[int, str], percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {i: frozenset(ngram_join.shingles(t).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for token in s:
            holders[token].append(i)
    for i, s in sets.items():
        for j, common in Counter(j for token in s for j in holders[token] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in sets:
        groups[root(i)].append(i)
    return {i: (len(sets[i]), min(g)) for g in groups.values() for i in g}


def test_join_against_brute_force(spark, documents):
    rows = QUERIES["op6_ngram_join"](spark, DIR).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components({i: t for i, t, _ in documents})


def test_join_of_chains_and_dense_groups(spark):
    draw = np.random.default_rng(1)
    base = [f"w{k}" for k in draw.integers(0, 5000, 160)]
    texts, number = {}, 0
    for _ in range(140):
        words = list(base)
        for k in draw.integers(0, 160, draw.integers(0, 5)):
            words[k] = f"new{draw.integers(0, 40)}"
        texts[number := number + 1] = " ".join(words)
    chain = [f"c{k}" for k in range(120)]
    for step in range(30):
        texts[number := number + 1] = " ".join(chain[step:] + [f"d{k}" for k in range(step)])
    shared = " ".join(f"s{k}" for k in range(60))
    for k in range(60):
        texts[number := number + 1] = shared + " " + " ".join(f"u{k}x{j}" for j in range(40 + k % 3))
    texts[number := number + 1] = "only three words"
    texts[number := number + 1] = "ONLY  three\nwords"
    found = ngram_join.link(frame(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts)


def test_one_of_each_group_stays(spark):
    near = PROSE.replace("river", "stream")
    rows = [(5, PROSE, "en", "a"), (3, near, "en", "a"), (3, near, "en", "a"), (3, "quite another text it is", "en", "a")]
    rows += [(9, "", "en", "a"), (8, None, "en", "a"), (None, PROSE, "en", "a"), (7, PROSE.lower(), "en", "b")]
    docs = frame(spark, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(3, near), (3, "quite another text it is"), (9, ""), (8, None), (None, PROSE)], key=str)


def test_mix_is_whole_and_repeatable(spark):
    rows = [(k, PROSE[: 20 + 7 * (k % 50)], "en", "big" if k % 3 else f"s{k % 4}") for k in range(600)] + [(600, "a b c", "en", None)]
    docs = frame(spark, rows)
    first, again = (sorted(map(tuple, mixing.draw(d, rows_per_range=50).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert first == again
    drawn = mixing.draw(docs, rows_per_range=50).toPandas()
    per = drawn.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert math.isclose(per["target"].sum(), per["size"].sum())
    assert (per["target"] <= 3 * per["size"] + 1e-9).all() and (abs(per["taken"] - per["target"]) <= per["most"]).all()
    assert (drawn["taken"] <= 3 * drawn["size"]).all()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.draw(docs).toPandas()["epochs"].sum()


@pytest.mark.parametrize("text", ["1234567 89", "words and 12345678901234567890", "only words"])
def test_key_ranges_are_even_at_any_quality(spark, text):
    """A source whose documents are all poor, or poor and good, has no range with most of its rows."""
    poor = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(text).alias("text"))
    good = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("good words only").alias("text"))
    none = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(text).alias("text"))
    rows = poor.unionByName(good).unionByName(none).withColumn("quality", mixing.quality_weight(F.col("text")))
    rows = rows.withColumn("key", -F.log(mixing.uniform([F.col("doc_id"), F.col("text")], 17)) / F.col("quality"))
    ranges = mixing.key_ranges(rows, 1_000).groupBy("source", "_range").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    found = [r.asDict() for r in ranges.orderBy("source", "_range").collect()]
    assert sum(r["n"] for r in found) == 25_000
    assert max(r["n"] for r in found) <= 1_300 and len(found) == 25
    for one, other in zip(found, found[1:]):
        assert one["source"] != other["source"] or one["hi"] < other["lo"]


def test_packing_is_a_round_trip(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op7_sequence_packing"](spark, DIR).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc_id, text, _ in documents:
        ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * -(-total // 2048) + 1


def test_added_tokens_in_texts_are_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("<|endoftext|>", PROSE + "<|endoftext|> and<|endoftext|>\n" + PROSE, "<|endof text|>", PROSE):
        ids = packing.token_ids(text).tolist()
        assert ids == [*exact.encode(text, add_special_tokens=False).ids, 0]
        assert ids.count(50256) == text.count("<|endoftext|>")


@pytest.mark.parametrize("lengths", [[700] * 1000 + [5] * 3, [2048] * 5, [1] * 5000, [], [1025] * 9, list(range(1, 2049))])
def test_plan_uses_every_length_as_often_as_it_is_there(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=2049)
    used = Counter()
    for repeats, held in packing.plan(counts):
        assert repeats > 0 and 0 < sum(held) <= 2048
        for length in held:
            used[length] += repeats
    assert used == Counter(lengths)
    numbers = defaultdict(list)
    for length, first, many, _, _ in packing.slots(packing.plan(counts), chunk=7):
        numbers[length] += range(first, first + many)
    assert {k: sorted(v) == list(range(used[k])) for k, v in numbers.items()} == dict.fromkeys(used, True)


def test_language_model_against_counts(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op10_language_model"](spark, DIR).collect()}
    words = {i: [*t.encode().lower().split(), b""] for i, t, _ in documents}
    seen = Counter(w for i, ws in words.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(seen.values()), len(seen)
    model = base = 0.0
    for i, ws in words.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(ws), sum(seen[w] > 0 for w in ws), n)
        wanted = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)
        assert math.isclose(r.base_score, wanted, rel_tol=1e-9)
        if r.held_out:
            model, base = model + r.score, base + r.base_score
    assert model > base


def test_language_model_learns_from_every_position(spark):
    docs = frame(spark, [(k, " ".join(f"w{k}x{j}" for j in range(10)), "en", "s") for k in range(30)])
    words = language_model.learn_words(language_model.count_words(docs))
    start, trained = language_model.Parameters.first(words.start), language_model.train(docs, words)
    # Every word stands before another one, once; only positions that are trained on move its vector.
    numbers = [words.vector[k] for w, k in words.index.items() if w]
    assert len(numbers) == 300
    assert (abs(trained.q[numbers] - start.q[numbers]).max(axis=1) > 1e-5).all()


def test_language_model_is_normalised():
    draw = np.random.default_rng(0)
    uni = np.append(0.0, draw.dirichlet(np.ones(40)))
    trainer = language_model.Trainer(uni)
    for _ in range(50):
        trainer.step(*draw.integers(1, 41, (3, 64)))
    tables = language_model.Tables(trainer.p)
    for a, b in ((0, 0), (3, 0), (7, 12)):
        total = np.exp(tables.one[a] + tables.two[b] - tables.norm[a, b]).sum()
        assert abs(total - 1) < 1e-3


def test_frequent_words_or_not_give_the_same_base(spark, monkeypatch):
    docs = frame(spark, [(k, PROSE[k:] + " zz" * (k % 5), "en", "s") for k in range(40)])
    whole = {r.doc_id: (r.n_known, r.base_score) for r in language_model.predict(docs).collect()}
    plain = language_model.learn_words
    monkeypatch.setattr(language_model, "learn_words", lambda counts: plain(counts, known=10))
    part = {r.doc_id: (r.n_known, r.base_score) for r in language_model.predict(docs).collect()}
    assert all(whole[i][0] == part[i][0] and math.isclose(whole[i][1], part[i][1], rel_tol=1e-9) for i in whole)

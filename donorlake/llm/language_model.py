"""Scoring texts with a log-bilinear language model.

The model predicts a token from the two before it: their vectors, each times a matrix of its place, add up to a
predicted vector, and the score of a token is the product with its own vector, plus a bias. It is trained with
noise-contrastive estimation, so training needs no normaliser. Scoring does: as the score is a sum over the two places,
the normalisers of all pairs of contexts are one matrix product of exponentials, made once per worker, and after that
every token's normalised log-probability is three look-ups.

Words the model has no vector for belong to one of a few classes by their beginning and end; the class is predicted by
the model, and the word within its class by its count.

Three passes over all documents: words are counted (in tasks first, then by a shuffle); every task trains on all
positions of its own documents, from one common start, and the parameters are averaged by the number of positions trained on; every text is
scored. Frequent words, ``KNOWN`` at most, are broadcast with their counts; all others are joined by word, whatever
there are of them. Their counts lie below those of the frequent ones, so no word of the join is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from donorlake.llm.common import cut, python_workers
from donorlake.llm.language_id import held_out

KNOWN = 1 << 17
#: Tokens with a vector: the beginning (a context only), the end, classes of other words, and the most frequent words.
VECTORS = 2048
BEGIN, END = 0, 1
STARTS, ENDINGS = 32, 3
CLASSES = STARTS * ENDINGS
WIDTH = 24
BATCH, NOISE, RATE = 512, 96, 0.15
SEED = 10


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    """The vector of a word that has none of its own: by its first two bytes and whether it ends a clause."""
    start = (word[0] * 31 + (word[1] if len(word) > 1 else 0)) % STARTS
    return 2 + start * ENDINGS + (0 if word.endswith(b".") else 1 if word.endswith(b",") else 2)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all rows of the column; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                seen.update(tokens(value.as_py()))
                seen[b""] += 1
                if len(seen) > 500_000:
                    yield out()
        yield out()

    python_workers(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Words:
    """What all workers know of the words: the frequent ones, and totals."""

    index: dict[bytes, int]
    counts: np.ndarray
    vector: np.ndarray
    n: int
    v: int
    in_class: np.ndarray
    start: np.ndarray

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number in the index (-1: not frequent) and vector of each word, and of the end behind them."""
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.append(at, get(b"", -1))
        vec = self.vector[at]
        for k in np.flatnonzero(at < 0):
            vec[k] = class_of(words[k]) if k < len(words) else END
        return at, vec


def learn_words(counts: DataFrame, known: int = KNOWN, vectors: int = VECTORS) -> Words:
    """Totals and the frequent words. The driver sees a histogram of counts and at most ``known`` words, and the end."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("n") * 8)
    histogram = sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["b"])
    least, held = None, 0
    for row in histogram:
        held += row["m"]
        if held > known:
            break
        least = row["b"]
    # The end is always among them: it stands in every text.
    frequent = (F.length("word") == 0) if least is None else (F.length("word") == 0) | (step >= least)
    rows = counts.filter(frequent).collect()
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    # By first byte, second byte and ending, as class_of has it.
    word, size = F.col("word"), F.length("word")

    def byte(at: Column) -> Column:
        return F.conv(F.hex(F.substring(word, at, F.lit(1))), 16, 10).cast("int")

    last = byte(size)
    start = (byte(F.lit(1)) * 31 + F.when(size > 1, byte(F.lit(2))).otherwise(0)) % STARTS
    kind = 2 + start * ENDINGS + F.when(last == 46, 0).when(last == 44, 1).otherwise(2)
    in_class = np.zeros((2 + CLASSES, 2))
    for row in counts.filter(size > 0).groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        in_class[row["k"]] = row["n"], row["v"]
    index = {bytes(r["word"]): k for k, r in enumerate(rows)}
    numbers = np.array([r["n"] for r in rows] + [0], np.int64)
    vector = np.array([class_of(w) if w else END for w in index] + [0], np.int32)
    own = [k for k, r in enumerate(rows) if r["word"]][: vectors - 2 - CLASSES]
    for place, k in enumerate(own):
        in_class[vector[k]] -= numbers[k], 1
        vector[k] = 2 + CLASSES + place
    # Unigrams of the vectors, for noise and the first bias.
    uni = np.zeros(2 + CLASSES + len(own))
    uni[: 2 + CLASSES] = in_class[:, 0]
    uni[END] = numbers[index[b""]] if b"" in index else 1
    uni[vector[own]] = numbers[own]
    uni = np.maximum(uni, 0.5)
    uni[BEGIN] = 0
    return Words(index, numbers, vector, int(total["n"] or 0), int(total["v"]), in_class, uni / uni.sum())


@dataclass
class Parameters:
    """Vectors of contexts (q) and targets (r), a matrix for each place before the target (c), biases of targets."""

    q: np.ndarray
    r: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @classmethod
    def first(cls, uni: np.ndarray) -> Parameters:
        draw = np.random.default_rng(SEED)
        n = len(uni)
        small = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
        eye = np.eye(WIDTH, dtype=np.float32)
        bias = np.log(np.maximum(uni, 1e-30)).astype(np.float32)
        return cls(small(n, WIDTH), small(n, WIDTH), np.stack([eye, eye]) + small(2, WIDTH, WIDTH), bias)

    def rows(self) -> np.ndarray:
        """All parameters as one matrix: q, r and c below each other, the biases beside r."""
        beside = np.zeros((len(self.q) + len(self.r) + 2 * WIDTH, 1), np.float32)
        beside[len(self.q) : len(self.q) + len(self.r), 0] = self.b
        return np.hstack([np.concatenate([self.q, self.r, *self.c]), beside])

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Parameters:
        n = (len(rows) - 2 * WIDTH) // 2
        c = rows[2 * n :, :WIDTH].reshape(2, WIDTH, WIDTH)
        return cls(rows[:n, :WIDTH], rows[n : 2 * n, :WIDTH], c, rows[n : 2 * n, WIDTH])


def contexts(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors one and two places before each token; the beginning where there is none."""
    return np.concatenate([[BEGIN], vec[:-1]]), np.concatenate([[BEGIN, BEGIN], vec[:-2]])[: len(vec)]


class Trainer:
    """Noise-contrastive steps with AdaGrad; all targets of a batch share the noise."""

    def __init__(self, uni: np.ndarray, seed: int = SEED) -> None:
        self.p = Parameters.first(uni)
        self.uni = uni
        self.log_noise = np.log(NOISE * np.maximum(uni, 1e-30)).astype(np.float32)
        self.cumulative = uni.cumsum()
        self.draw = np.random.default_rng(seed)
        self.sums = [np.full(a.shape[:1] if a.ndim == 2 else a.shape, 0.1, np.float32) for a in (self.p.q, self.p.r, self.p.c, self.p.b)]
        self.done = 0

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulative, self.draw.random(NOISE) * self.cumulative[-1]), len(self.uni) - 1)
        qa, qb = p.q[a], p.q[b]
        h = qa @ p.c[0] + qb @ p.c[1]
        own, other = p.r[w], p.r[noise]
        right = np.einsum("ij,ij->i", h, own) + (p.b[w] - self.log_noise[w])
        g = 1 / (1 + np.exp(np.clip(right, -30, 30)))
        # In place, as this is the largest array of a step: e = -1 / (1 + exp(-wrong)).
        e = h @ other.T
        e += p.b[noise] - self.log_noise[noise]
        np.clip(e, -30, 30, out=e)
        np.exp(np.negative(e, out=e), out=e)
        e += 1
        np.divide(-1, e, out=e)
        gh = g[:, None] * own + e @ other
        targets = np.concatenate([g[:, None] * h, e.T @ h]), np.concatenate([g, e.sum(axis=0)])
        self._rows((p.r, p.b), (self.sums[1], self.sums[3]), np.concatenate([w, noise]), targets)
        gc = np.stack([qa.T @ gh, qb.T @ gh]) / len(w)
        self.sums[2] += gc**2
        p.c += RATE * 0.1 * gc / np.sqrt(self.sums[2])
        self._rows((p.q,), (self.sums[0],), np.concatenate([a, b]), (np.concatenate([gh @ p.c[0].T, gh @ p.c[1].T]),))
        self.done += len(w)

    @staticmethod
    def _rows(tables: tuple[np.ndarray, ...], sums: tuple[np.ndarray, ...], rows: np.ndarray, grads: tuple[np.ndarray, ...]) -> None:
        # Numbers of two bytes are sorted by radix.
        rows = rows.astype(np.min_scalar_type(len(tables[0])))
        order = np.argsort(rows, kind="stable")
        ordered = rows[order]
        first = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
        at = ordered[first]
        for table, total, grad in zip(tables, sums, grads, strict=True):
            pooled = np.add.reduceat(grad[order].astype(np.float32, copy=False), first, axis=0)
            if table.ndim == 2:
                total[at] += np.einsum("ij,ij->i", pooled, pooled) / pooled.shape[1]
                table[at] += RATE * pooled / np.sqrt(total[at])[:, None]
            else:
                total[at] += pooled**2
                table[at] += RATE * pooled / np.sqrt(total[at])


def train(docs: DataFrame, words: Words, text: str = "text") -> Parameters:
    """Train in every task on its own rows, and average. A task gives back one matrix of parameters."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(words)
    first = Parameters.first(words.start).rows()
    names = [f"v{k}" for k in range(WIDTH + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        trainer = Trainer(known.start)
        held: list[np.ndarray] = []
        n = 0

        def flush() -> None:
            rows = np.concatenate(held)
            rows = rows[trainer.draw.permutation(len(rows))]
            for at in range(0, len(rows), BATCH):
                trainer.step(*rows[at : at + BATCH].T)
            held.clear()

        for batch in batches:
            for value in batch.column(0):
                vec = known.look_up(tokens(value.as_py()))[1]
                a, b = contexts(vec)
                held.append(np.stack([vec, a, b], axis=1))
                n += len(vec)
                if n > 1 << 18:
                    flush()
                    n = 0
        if n:
            flush()
        if trainer.done:
            out = trainer.p.rows()
            columns = [pa.array(np.arange(len(out)), pa.int32()), pa.array(np.full(len(out), trainer.done), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(out[:, k]) for k in range(WIDTH + 1)]], names=["row", "weight", *names])

    schema = "row int, weight long, " + ", ".join(f"{name} float" for name in names)
    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, schema)
    means = [(F.sum(F.col(name) * F.col("weight")) / F.sum("weight")).alias(name) for name in names]
    out = first.copy()
    for row in parts.groupBy("row").agg(*means).collect():
        out[row["row"]] = row[1:]
    return Parameters.of_rows(out.astype(np.float32))


class Tables:
    """Log-probabilities of all targets after all pairs of contexts, as two tables and their normalisers."""

    def __init__(self, p: Parameters) -> None:
        self.one = (p.q @ p.c[0]) @ p.r.T
        self.two = (p.q @ p.c[1]) @ p.r.T + p.b
        self.one[:, BEGIN] = self.two[:, BEGIN] = -1e4
        m1, m2 = self.one.max(axis=1, keepdims=True), self.two.max(axis=1, keepdims=True)
        total = np.exp(self.one - m1) @ np.exp(self.two - m2).T
        self.norm = np.log(np.maximum(total, 1e-30)) + m1 + m2.T

    def log10(self, vec: np.ndarray) -> np.ndarray:
        a, b = contexts(vec)
        return (self.one[a, vec] + self.two[b, vec] - self.norm[a, b]) / math.log(10)


_TABLES: dict[int, Tables] = {}


def _tables(number: int, p: Parameters) -> Tables:
    """One set of tables per worker process; a new model takes the place of the old."""
    if number not in _TABLES:
        _TABLES.clear()
        _TABLES[number] = Tables(p)
    return _TABLES[number]


def score(docs: DataFrame, counts: DataFrame, words: Words, parameters: Parameters, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast((words, parameters))
    number = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)
    whole = float(words.n + words.v + 1)
    sure = np.log10(words.counts + 1.0)
    inside = np.log10(np.maximum(words.in_class.sum(axis=1), 0) + 1)
    seen_all = words.counts > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p = shared.value
        tables = _tables(number, p)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out: list[tuple] = []
                for value in part.column(1):
                    found = tokens(value.as_py())
                    at, vec = known.look_up(found)
                    model = tables.log10(vec).sum()
                    classed = (vec >= 2) & (vec < 2 + CLASSES)
                    model -= inside[vec[classed]].sum()
                    held = sure[at]
                    model += held[classed].sum()
                    rare = Counter(found[k] for k in np.flatnonzero(at[:-1] < 0))
                    out.append((len(at), int(seen_all[at].sum()), float(held.sum()), float(model), list(rare), list(rare.values())))
                n, k, base, model, rare_words, times = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(k, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(model, pa.float64()),
                        pa.array(rare_words, pa.list_(pa.binary())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_tokens", "k", "b", "m", "rare", "times"],
                )

    schema = "doc_id long, n_tokens long, k long, b double, m double, rare array<binary>, times array<long>"
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    scored = cut(slim.mapInArrow(run, schema)).withColumns({"at": F.monotonically_increasing_id()})
    rare = scored.filter(F.size("rare") > 0).select("at", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("at", F.col("x.rare").alias("word"), F.col("x.times").alias("times")).join(counts, "word")
    sums = rare.groupBy("at").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = scored.drop("rare", "times").join(sums, "at", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("k") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.n).cast("bigint").alias("train_tokens"),
        (F.col("b") + logs - F.col("n_tokens") * math.log10(whole)).alias("base_score"),
        (F.col("m") + logs).alias("score"),
    )


def predict(docs: DataFrame, text: str = "text", mod: int = 7, rest: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Learned from all rows that have an id and are not held out. Null and blank texts are the end alone. If nothing can
    be learned from, no token is known, and the model is its own start. Repeated rows count each, and score alike.
    Other columns are ignored. No rows in, no rows out.
    """
    learning = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    counts = cut(count_words(learning, text))
    words = learn_words(counts)
    parameters = train(learning, words, text)
    found = score(docs, counts, words, parameters, text)
    return found.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

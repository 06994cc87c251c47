"""Toxicity by multiple-instance learning.

Labels are for documents, offence is in sentences. A sentence's chance of being offensive is a logistic function of the
words it holds, a document's is the noisy-or of its sentences: 1 - prod(1 - p). A sentence adds what its log odds have
above ``FLOOR``: sentences that hold nothing known, or weak signs only, add nothing, however many there are. Of what
sentences add together, a text has the part that clean text of as many sentences comes to by chance taken off
(``background``), but it never scores less than its worst sentence, so that length alone makes no text offensive and
hides no offence. What no sentence tells is a chance of the document as a whole (``leak``). Weights are fitted to
document labels through the noisy-or, and the same sentence scores then tell where the offence is (``locate``).

Features of a sentence are its words and the beginnings of its words (four to eight letters), as offensive stems
come with many endings, known by their checksum in ``SLOTS`` slots. Which of them count is learned: the ones whose
share among toxic documents differs most from that among others. Fitting sees a bounded sample of the labelled
documents, ``TOXIC`` and ``OTHERS`` of them, the first in the order of a checksum, with their whole texts. Only where
these come to more than ``LETTERS`` characters of a label, the longest are left out. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from donorlake.llm.common import python_workers
from donorlake.llm.language_id import held_out

TOXIC, OTHERS, LETTERS = 2000, 4000, 30_000_000
SLOTS = 1 << 22
#: How many features at most, and in how many toxic documents of the sample one has to be.
FEATURES, LEAST = 3000, 5
#: Steps and rate, first with all odds and then with those above the floor only.
STEPS, DECAY = ((300, 0.1), (150, 0.02)), 2e-4
#: Log odds of a sentence that holds no feature, and of a document by itself, before learning: offence is rare.
PRIOR, LEAK = -9.0, -4.0
#: Log odds from which a sentence counts.
FLOOR = -1.0

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = range(4, 9)


def _of_word(word: str) -> tuple[int, ...]:
    """The slots of a word and its beginnings."""
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in ("=" + word, *(word[:n] for n in _STEMS if n <= len(word))))


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float
    leak: float = PRIOR
    background: float = 0.0

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, log odds) of the sentences of a text, by characters, case ignored."""
        # Lower case may be longer than the text; such texts are folded letter by letter.
        low = (text or "").lower()
        if len(low) != len(text or ""):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text or "")
        out = []
        for m in _SENTENCE.finditer(low):
            found = {f for w in set(_WORD.findall(m[0])) for f in self._known(w)}
            out.append((m.start(), m.end(), self.bias + sum(self.weights[f] for f in sorted(found))))
        return out

    def _known(self, word: str) -> list[int]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[word] = [f for f in _of_word(word) if f in self.weights]
        return got

    @property
    def cache(self) -> dict[str, list[int]]:
        if "_cache" not in self.__dict__:
            object.__setattr__(self, "_cache", {})
        return self.__dict__["_cache"]

    def score(self, text: str | None) -> float:
        """The noisy-or of the sentences; 0 without any."""
        return self.of_odds(np.array([o for _, _, o in self.sentences(text)]))

    def of_odds(self, odds: np.ndarray) -> float:
        """The noisy-or of sentences by their log odds, for what these have above the floor and the background."""
        if not len(odds):
            return 0.0
        added = _added(odds)
        told = max(added.max(), added.sum() - self.background * len(odds))
        return float(-np.expm1(-told - np.logaddexp(0.0, self.leak)))


def _added(odds: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """What each sentence takes from the log of a document's chance to be clean."""
    return np.maximum(np.logaddexp(0.0, odds) - np.logaddexp(0.0, floor), 0.0)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of all documents. Its background is what clean documents of one half add under a model of the other."""
    added, sentences = 0.0, 0
    for half in (0, 1):
        model = climb(texts[half::2], toxic[half::2])
        for text, label in zip(texts[1 - half :: 2], toxic[1 - half :: 2], strict=True):
            if not label:
                odds = np.array([o for _, _, o in model.sentences(text)])
                added, sentences = added + float(_added(odds).sum()), sentences + len(odds)
    return replace(climb(texts, toxic), background=added / max(sentences, 1))


def climb(texts: list[str], toxic: list[int]) -> Model:
    """Choose features by their log ratio of shares, then climb the noisy-or likelihood with Adam."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model({}, PRIOR)
    slots = lru_cache(maxsize=200_000)(_of_word)
    seen = np.zeros((2, SLOTS), np.int32)
    for text, label in zip(texts, toxic, strict=True):
        seen[label, list({f for w in set(_WORD.findall(text.lower())) for f in slots(w)})] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    lift = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    able = np.flatnonzero((seen[1] >= LEAST) & (lift > 0.7))
    chosen = able[np.argsort(-lift[able], kind="stable")][:FEATURES]
    number = {int(f): k for k, f in enumerate(chosen)}
    doc, row, col, rows = [], [], [], 0
    for k, text in enumerate(texts):
        for sentence in _SENTENCE.findall(text.lower()):
            held = {number[f] for w in set(_WORD.findall(sentence)) for f in slots(w) if f in number}
            if not held:
                continue
            doc.append(k)
            row += [rows] * len(held)
            col += sorted(held)
            rows += 1
    doc, row, col = np.array(doc, int), np.array(row, int), np.array(col, int)
    w, b, leak = np.zeros(len(chosen)), PRIOR, LEAK
    for floor, (steps, rate) in zip((-np.inf, FLOOR), STEPS, strict=True):
        m, v = np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)
        for step in range(1, steps + 1):
            odds = b + np.bincount(row, weights=w[col], minlength=rows)
            counts = odds > floor
            clean = -np.bincount(doc, weights=_added(odds, floor), minlength=len(y)) - np.logaddexp(0.0, leak)
            p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
            # d log-likelihood / d odds: for a toxic document (1 - P) / P times its sentence's chance, else minus that chance.
            pull = np.where(y > 0, (1 - p) / p, -1.0)
            g = pull[doc] * counts / (1 + np.exp(-odds))
            whole = (pull / (1 + np.exp(-leak))).sum()
            grad = np.concatenate([np.bincount(col, weights=g[row], minlength=len(chosen)), [g.sum(), whole]]) / len(y)
            grad[:-1] -= DECAY * np.append(w, b - PRIOR)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            # The bias stays below the floor: a sentence without a feature never counts.
            w, b, leak = w + move[:-2], min(b + move[-2], FLOOR), leak + move[-1]
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, float(b), float(leak))


def sample(docs: DataFrame, labels: DataFrame, trains: Column, text: str = "text") -> tuple[list[str], list[int]]:
    """The labelled sample, in a fixed order: a bounded number of rows reaches the driver. Labels but 0 and 1 are ignored."""
    marked = labels.filter(trains & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(8))
    fits = docs.filter(F.col(text).rlike(r"\p{L}")).select("doc_id", F.col(text).alias("text"))
    # Rows of one id come together, so they count together.
    letters = fits.groupBy("doc_id").agg(F.sum(F.length("text")).alias("letters"))
    ranked = marked.join(letters, "doc_id").withColumn("place", order)
    # Each task keeps the first rows of a label, and only those are put in order together.
    first, others = (ranked.filter(F.col("label") == label).orderBy("place", "doc_id").limit(n) for label, n in ((1, TOXIC), (0, OTHERS)))
    first = first.unionByName(others)
    # At most TOXIC + OTHERS rows from here on, which is a bound for the window and the broadcast as well.
    up_to = F.sum("letters").over(Window.partitionBy("label").orderBy("letters", "place", "doc_id"))
    chosen = first.withColumn("up_to", up_to).filter(F.col("up_to") <= LETTERS).select("doc_id", "label", "place")
    rows = fits.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "place", "text").collect()
    rows.sort(key=lambda r: (r["place"], r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, score, n_offending`` for every row (sentences with more than even odds). Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for batch in batches:
            scores, counts = [], []
            for value in batch.column(1):
                odds = np.array([o for _, _, o in trained.sentences(value.as_py())])
                scores.append(trained.of_odds(odds))
                counts.append(int((odds > 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], names=["doc_id", "score", "n_offending"]
            )

    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, score double, n_offending long"
    )


def locate(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``doc_id, start, end, score`` of the sentences whose own chance reaches ``least``; positions in characters."""
    bar = np.log(least / (1 - least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for batch in batches:
            rows = [
                (doc_id, s, e, float(1 / (1 + np.exp(-odds))))
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for s, e, odds in trained.sentences(value.as_py())
                if odds >= bar
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "end", "score"])

    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, start long, end long, score double"
    )


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", mod: int = 5, rest: int = 0) -> Model:
    trains = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest)
    return fit(*sample(docs, labels, trains, text))


def predict(docs: DataFrame, labels: DataFrame, text: str = "text", mod: int = 5, rest: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_offending`` for every row, learned from labels of rows not held out.

    Null and empty texts, and texts without sentences, score 0. Without labels of both kinds nothing is learned and all
    scores stay near 0. A doc_id with several labels counts as toxic if one of them says so. Repeated rows are judged
    alike; rows without an id are judged, but neither learned from nor held out. Other columns are ignored.
    """
    found = score(docs, learn(docs, labels, text, mod, rest), text)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), mod, rest).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_offending",
    )

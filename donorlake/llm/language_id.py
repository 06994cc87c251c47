"""Language identification with string kernels.

The kernel of two texts counts the letter n-grams of one to three characters that both hold (presence, not frequency;
all three lengths blended), scaled by the number each holds. A few texts per language are landmarks: the Nyström method
writes every text as its kernel values with the landmarks, whitened by the kernel matrix among the landmarks, and
one-versus-rest kernel ridge regression on these features gives a score per language.

Fitting sees a bounded sample of the labelled rows: ``PER_LANGUAGE`` rows of each language, the ones first in the order
of a checksum, texts of up to ``LONGEST`` characters. Scoring reads every whole text, in batches of matrix products: a
batch of presence vectors times the landmarks' vectors times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from donorlake.llm.common import python_workers

#: The sample: rows per language, of which the first are landmarks, and the length up to which a text may be in it.
PER_LANGUAGE = 150
LANDMARKS = 50
LONGEST = 20_000
RIDGE = 1e-2
#: Letters with a code of their own (the sample's most frequent), and codes that all others share by their number.
OWN_CODES, SHARED_CODES = 80, 14
BASE = OWN_CODES + SHARED_CODES + 1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str | None) -> np.ndarray:
    """Code points of the text in lower case, 0 for whatever is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, 0)


def _grams(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of one to three characters; gaps between words count as one character."""
    gap = points == 0
    c = codes[points[~(gap & np.append(False, gap[:-1]))]] if len(points) else np.zeros(0, np.int64)
    return np.concatenate([c, BASE + c[:-1] * BASE + c[1:], BASE + BASE**2 + (c[:-2] * BASE + c[1:-1]) * BASE + c[2:]])


SPACE = BASE + BASE**2 + BASE**3


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, points: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts with the landmarks."""
        width = self.landmarks.shape[1]
        there = np.zeros((len(points), width + 1), np.float32)
        for row, p in zip(there, points, strict=True):
            row[self.columns[_grams(p, self.codes)]] = 1.0
        there = there[:, :width]
        size = np.sqrt(np.maximum(there.sum(axis=1, keepdims=True), 1.0))
        return (there / size) @ self.landmarks.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points = [_points(t) for t in texts]
        known = [bool((p > 0).any()) for p in points]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        scores = self.kernel(points).astype(np.float64) @ self.weights
        best = scores.argmax(axis=1)
        top = np.clip((scores.max(axis=1) + 1) / 2, 0.0, 1.0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features of the texts and a ridge regression per language. No labelled text gives a model that knows none."""
    languages = tuple(sorted(set(labels)))
    points = [_points(t) for t in texts]
    used = np.bincount(np.concatenate([p[p > 0] for p in points] or [np.zeros(0, int)]).astype(int), minlength=0x110000)
    order = np.argsort(-used, kind="stable")[:OWN_CODES]
    codes = 1 + OWN_CODES + np.arange(0x110000) % SHARED_CODES
    codes[order[used[order] > 0]] = 1 + np.arange((used[order] > 0).sum())
    codes[0] = 0
    if not languages:
        return Model((), codes, np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    chosen = [i for lang in languages for i in [k for k, v in enumerate(labels) if v == lang][:landmarks]]
    sets = [np.unique(_grams(points[i], codes)) for i in chosen]
    grams = np.unique(np.concatenate(sets))
    columns = np.full(SPACE, len(grams), np.int32)
    columns[grams] = np.arange(len(grams))
    marks = np.zeros((len(chosen), len(grams)), np.float32)
    for row, s in zip(marks, sets, strict=True):
        row[columns[s]] = 1 / np.sqrt(len(s))
    bare = Model(languages, codes, columns, marks, np.zeros((len(chosen), len(languages))))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = bare.kernel(points).astype(np.float64) @ whiten
    wanted = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Languages weigh alike, however many rows of each there are.
    share = np.array([1.0 / labels.count(label) for label in labels])[:, None] * len(labels) / len(languages)
    solved = np.linalg.solve(features.T @ (features * share) + ridge * len(labels) * np.eye(features.shape[1]), features.T @ (wanted * share))
    return Model(languages, codes, columns, marks, whiten @ solved)


def sample(docs: DataFrame, trains: Column, text: str = "text", lang: str = "lang", rows: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """The labelled sample, in a fixed order: at most ``rows`` texts per language reach the driver."""
    labelled = docs.filter(trains & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.length(text) <= LONGEST))
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    ranked = labelled.select("doc_id", F.col(lang).alias("lang"), order.alias("place"))
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
    ids = [row["doc_id"] for row in ranked.filter(F.col("at") <= rows).select("doc_id").distinct().collect()]
    found = labelled.filter(F.col("doc_id").isin(ids)) if ids else labelled.filter("false")
    found = found.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("place"))
    # An id may have any number of rows, so these are bounded once more.
    again = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text")))
    picked = found.withColumn("at", again).filter(F.col("at") <= rows).drop("at").collect()
    picked.sort(key=lambda row: (row["place"], row["doc_id"], row["lang"], row["text"]))
    return [row["text"] for row in picked], [row["lang"] for row in picked]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; ``und`` and 0 where there is no letter. Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, scores = trained.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``rest``; false where there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def predict(docs: DataFrame, text: str = "text", lang: str = "lang", mod: int = 3, rest: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from rows that are not held out.

    Rows without an id are not learned from and not held out. Null texts and texts without letters are ``und`` with
    score 0; so is everything if there is no labelled row. Repeated rows are judged alike. Other columns are ignored.
    """
    trains = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest)
    model = fit(*sample(docs, trains, text, lang))
    found = identify(docs, model, text)
    return found.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "lang_pred", "score")

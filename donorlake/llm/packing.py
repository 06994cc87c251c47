"""Best-fit packing of documents into fixed-length sequences, by patterns and non-negative least squares.

How documents share sequences depends on their lengths alone, and a length is at most that of a sequence. So the plan
is made on the histogram of lengths: patterns of a few lengths that fill a sequence exactly are enumerated, how often
each is to be used is fitted to the histogram by non-negative least squares, rounded, and what is left over is packed
by best fit. Histogram and plan are bounded by the sequence length (2048 counts, and patterns of at most three of
them), whatever the corpus holds. Documents find their place by their number among those of the same length, counted
in buckets and so never in one task.

Tokens come from a public byte-level BPE vocabulary. The ids are those the ``tokenizers`` library gives for it; the
ranks of the same vocabulary in ``tiktoken`` give the same ids several times faster, and a text that library can't take
goes to the first one.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from donorlake.llm.common import cut, python_workers

SEQUENCE = 2048
END = 0
ROUNDS = 150
#: Numbers within a length are counted in buckets of about this many pieces.
ROWS_PER_BUCKET = 20_000
#: Longer texts go to the first library: the second may run out of stack on them.
LONG_TEXT = 1_000_000


@lru_cache(maxsize=1)
def _encoders(vocabulary: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [token.content for token in exact.get_added_tokens_decoder().values()]
    return exact, fast, added


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of a text (null: none) and the end id, as little-endian unsigned 32-bit numbers."""
    exact, fast, added = _encoders(vocabulary)
    text = text or ""
    # The second library has no added tokens.
    if len(text) > LONG_TEXT or any(token in text for token in added):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


def pieces_of(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, but for the first, which has what is left over."""
    first = n % most or most
    return [(0, first)] + [(start, most) for start in range(first, n, most)]


def tokenize(docs: DataFrame, most: int = SEQUENCE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all pieces of all rows."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), vocabulary)
                for piece, (start, length) in enumerate(pieces_of(len(ids), most)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    python_workers(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, on the histogram ------------------------------------------------------------------------------------------


def patterns(lengths: np.ndarray, most: int = SEQUENCE) -> np.ndarray:
    """All ways to fill a sequence exactly with two or three of the lengths, as rows (a >= b >= c; c is 0 for two)."""
    there = np.zeros(most + 1, bool)
    there[lengths] = True
    there[0] = True
    rows = []
    for a in lengths[(lengths >= most // 3) & (lengths < most)]:
        rest = most - a
        b = np.arange(-(-rest // 2), min(a, rest) + 1)
        b = b[there[b] & there[rest - b] & (b > 0)]
        rows.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that come close to the histogram in the least-squares sense.

    Multiplicative steps x <- x * (A'h) / (A'Ax): they never leave x >= 0 and never make the fit worse. A has a 1 (or
    more, for a length used twice) where a pattern uses a length; entry 0 stands for "no third document".
    """
    most = len(counts) - 1
    h = counts.astype(float)
    h[0] = 0.0
    use = found > 0

    def gather(v: np.ndarray) -> np.ndarray:
        return (v[found] * use).sum(axis=1)

    def scatter(x: np.ndarray) -> np.ndarray:
        total = np.bincount(found.ravel(), weights=np.repeat(x, found.shape[1]), minlength=most + 1)
        total[0] = 0.0
        return total

    goal = gather(h)
    x = goal / max(1.0, gather(scatter(goal)).max() / max(goal.max(), 1e-9))
    for _ in range(rounds):
        x = x * goal / np.maximum(gather(scatter(x)), 1e-12)
    return x


def plan(counts: np.ndarray, most: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths in order) such that every length is used as often as ``counts`` (indexed by length) has it."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    done: list[tuple[int, tuple[int, ...]]] = []
    if left[most]:
        done.append((int(left[most]), (most,)))
        left[most] = 0
    lengths = np.flatnonzero(left)
    found = patterns(lengths, most)
    if len(found):
        x = fit(found, left)
        # Rounded, largest first, within what the histogram still has.
        for k in np.argsort(-x, kind="stable"):
            row = [int(v) for v in found[k] if v]
            n = min([int(np.rint(x[k]))] + [int(left[v]) // row.count(v) for v in row])
            if n > 0:
                done.append((n, tuple(row)))
                for v in row:
                    left[v] -= n
    return done + best_fit(left, most)


def best_fit(left: np.ndarray, most: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: equal lengths that meet equal gaps are placed at once."""
    gaps: dict[int, list[list]] = {}
    for length in range(most, 0, -1):
        n = int(left[length])
        while n > 0:
            gap = min((g for g in gaps if g >= length), default=0)
            if not gap:
                gaps.setdefault(most, []).append([n, ()])
                gap = most
            times = gap // length
            group = gaps[gap][-1]
            if group[0] * times <= n:
                bins, held = group
                gaps[gap].pop()
            elif n >= times:
                bins, held = n // times, group[1]
                group[0] -= bins
            else:
                bins, held, times = 1, group[1], n
                group[0] -= 1
            if gap in gaps and (not gaps[gap] or gaps[gap][-1][0] == 0):
                if gaps[gap]:
                    gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            n -= bins * times
            gaps.setdefault(gap - times * length, []).append([bins, held + (length,) * times])
        # Sequences opened for this length and not needed have nothing in them.
        if most in gaps:
            gaps[most] = [g for g in gaps[most] if g[1]]
            if not gaps[most]:
                del gaps[most]
    return [(bins, held) for groups in gaps.values() for bins, held in groups if held]


def slots(planned: list[tuple[int, tuple[int, ...]]], chunk: int = 50_000) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first number, how many, first sequence, offset): the documents first.. of a length go there in turn."""
    used: dict[int, int] = {}
    sequence = 0
    for repeats, held in planned:
        offset = 0
        for length in held:
            first = used.get(length, 0)
            for done in range(0, repeats, chunk):
                yield length, first + done, min(chunk, repeats - done), sequence + done, offset
            used[length] = first + repeats
            offset += length
        sequence += repeats


# --- on Spark ------------------------------------------------------------------------------------------------------------


def numbered(pieces: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``number``: 0, 1, 2... among the pieces of a length.

    Pieces of a length are dealt to buckets by checksum; a bucket is sorted alone and starts where the ones before end.
    """
    total = pieces.groupBy("length").agg(F.count("*").alias("_n"))
    # There are at most as many lengths as tokens in a sequence.
    rows = pieces.join(F.broadcast(total), "length")
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.ceil(F.col("_n") / rows_per_bucket))
    rows = rows.withColumns({"_bucket": deal})
    sizes = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_m"))
    so_far = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_m").over(so_far), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.join(sizes, ["length", "_bucket"])
    return rows.withColumns({"number": F.col("_earlier") + F.row_number().over(inside) - 1}).drop("_n", "_bucket", "_earlier")


def place(spark: SparkSession, pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces. The driver sees the histogram: ``most`` counts at most."""
    counts = np.zeros(most + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    columns = list(zip(*slots(plan(counts, most)), strict=True)) or [()] * 5
    names = ["length", "first", "many", "sequence", "offset"]
    runs = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))
    each = runs.select("length", "first", "sequence", "offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1)).alias("_k"))
    each = each.select("length", (F.col("first") + F.col("_k")).alias("number"), (F.col("sequence") + F.col("_k")).alias("sequence_id"), "offset")
    return numbered(pieces).join(each, ["length", "number"]).drop("number")


def pack(docs: DataFrame, most: int = SEQUENCE, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces of all rows.

    A document is its ids and an end id. Only documents longer than a sequence are cut. Null and empty texts are the end
    id alone. Repeated rows are packed each for itself. Other columns are ignored. No rows in, no rows out.
    """
    pieces = cut(tokenize(docs, most, vocabulary))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(docs.sparkSession, pieces, most).select(*columns)

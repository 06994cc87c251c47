"""Approximate nearest neighbours by cross-polytope hashing.

A table of the index turns each vector by a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform) and files it under the signed axis nearest to it. A query asks, in every table, the axes nearest to it, and
all that is filed there is ranked by its true distance. Distances are Euclidean, in double precision, on the vectors as
given; only the hashing looks at directions alone.

Equal vectors are filed once for the smallest ids only: as ties go to smaller ids, a result of k can hold no more than
k + 1 of them, the query's own row included. So a vector that a third of all rows share is no hot cell. Cells with many
different vectors are cut into blocks, queries and candidates alike, and each task ranks one block against another.
Queries that find fewer than k that way ask every cell of the first table, so small tables are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from donorlake.llm.common import cut, python_workers

TABLES, PROBES = 16, 8
ROUNDS = 3
SEED = 3
#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 4000, 1000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int) -> np.ndarray:
    """The rows as unit vectors, filled up with zeros to a power of two, in the rotation of a table."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    draw = np.random.default_rng([SEED, size, table])
    for _ in range(ROUNDS):
        x = hadamard(x * draw.choice([-1.0, 1.0], size))
    return x


def cells(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row (axis and sign as one number), nearest first."""
    y = turned(x, table)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id, vec`` of the vectors that take part, once each: an id, some components, none null or not finite, not all 0."""
    vec = F.col(embedding)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    fine = F.col(vec_id).isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))
    fine = vectors.filter(fine).select(F.col(vec_id).cast("bigint").alias("id"), vec.cast("array<double>").alias("vec"))
    return fine.groupBy("id", "vec").agg(F.lit(1).alias("_")).drop("_")


def filed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """``d, t, cell, id, vec`` of ``id, vec``: a row per table and probe; ``vec`` as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(-1, d)
                ids = batch.column(0).take(pa.array(at))
                raw = pa.array([row.tobytes() for row in x], pa.binary())
                for t in range(tables):
                    found = cells(x, t, probes)
                    for p in range(found.shape[1]):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, d), pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(found[:, p], pa.int32()), ids, raw],
                            names=["d", "t", "cell", "id", "vec"],
                        )

    python_workers(rows.sparkSession)
    return rows.select("id", "vec").mapInArrow(run, "d int, t int, cell int, id long, vec binary")


def ranked(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query, id, score``: the k nearest of every query in each block of the cells it asks."""
    cell = ["d", "t", "cell"]
    asked = queries.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_m"))
    held = candidates.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    blocks = asked.join(held, cell)

    def dealt(rows: DataFrame, own: str, other: str, role: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "vec"), F.col(own)).alias(own[1:])
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other[1:])
        both = rows.join(blocks, cell).select(*cell, mine, every, F.lit(role).alias("role"), "id", "vec")
        return both.select(*cell, "m", "n", "role", "id", "vec")

    def rank(group: pa.Table) -> pa.Table:
        d = group.column("d")[0].as_py()
        role = group.column("role").to_numpy()
        ids = group.column("id").to_numpy()
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(-1, d)
        mine, theirs = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out_q, out_i, out_s = [], [], []
        if len(theirs):
            for q in mine:
                score = np.sqrt(((x[theirs] - x[q]) ** 2).sum(axis=1))
                few = np.lexsort((ids[theirs], score))[:k] if len(theirs) <= 4 * k else _first(score, ids[theirs], k)
                out_q.append(np.full(len(few), ids[q]))
                out_i.append(ids[theirs][few])
                out_s.append(score[few])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query": join(out_q, np.int64), "id": join(out_i, np.int64), "score": join(out_s, np.float64)})

    rows = dealt(queries, "_m", "_n", 0).unionByName(dealt(candidates, "_n", "_m", 1))
    return rows.groupBy(*cell, "m", "n").applyInArrow(rank, "query long, id long, score double")


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties by id."""
    bar = np.partition(score, k - 1)[k - 1]
    near = np.flatnonzero(score <= bar)
    return near[np.lexsort((ids[near], score[near]))][:k]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row that ``is_query`` (an expression on ``id``).

    Rows that are null, without an id, all zeros or hold a null or a number that isn't finite take no part, neither do
    components of other lengths meet. A repeated row counts once; an id with several vectors is a query by each, and is
    listed with the least distance. An id is never its own neighbour. Fewer than k others are all returned. Other
    columns are ignored. No rows in, no rows out.
    """
    rows = cut(usable(vectors, vec_id, embedding))
    equal = Window.partitionBy("vec").orderBy("id")
    pool = rows.withColumn("_r", F.row_number().over(equal)).filter(F.col("_r") <= k + 1).drop("_r")
    pool = cut(pool)
    asking = rows.filter(is_query)
    distinct = asking.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    # A query stands for all of its vector, so its number has to be one of the vector's.
    numbered = cut(distinct.select(F.monotonically_increasing_id().alias("id"), "vec"))
    found = cut(ranked(filed(numbered, tables, probes), filed(pool, tables, 1), k + 1))

    def result(found: DataFrame) -> DataFrame:
        own = asking.withColumnRenamed("id", "query_id").join(numbered.withColumnRenamed("id", "query"), "vec").select("query_id", "query")
        best = found.groupBy("query", "id").agg(F.min("score").alias("score"))
        near = Window.partitionBy("query").orderBy("score", "id")
        best = best.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k + 1).drop("_r")
        pairs = own.join(best, "query").filter(F.col("id") != F.col("query_id"))
        pairs = pairs.groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return pairs.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # Those that met too few ask every cell of one table.
    short = found.groupBy("query").agg(F.count_distinct("id").alias("n")).filter(F.col("n") > k).select(F.col("query").alias("id"))
    short = cut(numbered.join(short, "id", "left_anti"))
    if short.isEmpty():
        return result(found)
    rest = ranked(filed(short, 1, 1 << 30), filed(pool, 1, 1), k + 1)
    return result(found.unionByName(rest))

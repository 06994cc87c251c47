"""Keyed folds: what a database upsert does, over a whole log.

Both folds combine on the map side, so that a key with very many rows reaches its reducer as one row per task. Both
are associative and do not care about the order of their inputs: folding batches and then the results gives the same
table as folding everything at once, and folding a batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def arrival(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def last_write(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Whole-row replace: per key the last arrival wins, nulls included. A null key never conflicts with another.

    ``row_number() == 1`` lets Spark keep one row per key and task ahead of the shuffle.
    """
    lone = F.when(F.col(key).isNull(), arrival(order))
    newest = Window.partitionBy(F.col(key), lone).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def first_write(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the first arrival is kept and later ones are dropped."""
    oldest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(oldest)).where(F.col("_rank") == 1).drop("_rank")


def newest_partials(
    df: DataFrame, key: str, order: Sequence[str], newest: Sequence[str], oldest: Sequence[str], updated: str
) -> DataFrame:
    """Column-wise merge state: each value travels with its arrival, so that states merge in any order."""
    seq = arrival(order)
    lone = F.when(F.col(key).isNull(), seq)
    state = df.select(
        F.col(key),
        lone.alias("_lone"),
        *[F.when(F.col(c).isNotNull(), F.struct(seq.alias("seq"), F.col(c).alias("v"))).alias(c) for c in newest],
        *[F.struct(seq.alias("seq"), F.col(c).alias("v")).alias(c) for c in oldest],
        F.struct(seq.alias("seq"), F.col(updated).alias("v")).alias("updated"),
    )
    return merge_partials(state, key, newest, oldest)


def merge_partials(state: DataFrame, key: str, newest: Sequence[str], oldest: Sequence[str]) -> DataFrame:
    return (
        state.groupBy(key, "_lone")
        .agg(
            *[F.max(c).alias(c) for c in newest],
            *[F.min(c).alias(c) for c in oldest],
            F.max("updated").alias("updated"),
        )
    )


def finish_partials(state: DataFrame, key: str, newest: Sequence[str], oldest: Sequence[str]) -> DataFrame:
    return state.select(key, *[F.col(f"{c}.v").alias(c) for c in [*newest, *oldest, "updated"]])


def merge_newest(
    df: DataFrame, key: str, order: Sequence[str], newest: Sequence[str], oldest: Sequence[str], updated: str
) -> DataFrame:
    """Per key: newest non-null of some columns, first value ever of others, time of the last write."""
    state = newest_partials(df, key, order, newest, oldest, updated)
    return finish_partials(state, key, newest, oldest)


def one_per_key(df: DataFrame, *keys: str, count: str | None = None) -> DataFrame:
    """One row per key, whatever a log repeats: of rows that differ, the least in the order of their columns.

    Combined ahead of its one shuffle, which a join on the keys then shares. Rows without a key are dropped. ``count``
    names a column for the number of rows of the key.
    """
    others = [c for c in df.columns if c not in keys]
    known = df.dropna(subset=list(keys))
    numbers = [F.count("*").alias(count)] if count else []
    least = known.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"), *numbers)
    return least.select(*keys, *[F.col("_row")[c].alias(c) for c in others], *([count] if count else []))

"""Joins against tables that have one row per key.

Broadcasting is left to Spark, which compares a table's size with ``spark.sql.autoBroadcastJoinThreshold``, and so are
hot keys: the side with many rows per key is split where it is skewed, as the table's side has one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from donorlake.operators import folds


def look_up_left(facts: DataFrame, table: DataFrame, fact_key: Column, table_key: str, row_id: Column) -> DataFrame:
    """Left join in which rows without a key are spread over all tasks.

    A key that the table repeats counts once. Null keys would all hash to one task. They get the row id as their key instead, in a second key column that never
    matches.
    """
    keyed = facts.withColumns({"_key": fact_key, "_spread": F.when(fact_key.isNull(), F.xxhash64(row_id)).otherwise(F.lit(0))})
    right = folds.one_per_key(table.withColumnRenamed(table_key, "_key"), "_key").withColumn("_spread", F.lit(0).cast("bigint"))
    return keyed.join(right, ["_key", "_spread"], "left").drop("_key", "_spread")

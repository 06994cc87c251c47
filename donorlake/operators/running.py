"""Running values along the rows of a key, for keys of any size.

A window over a whole key puts all its rows into one task. Here a key is cut into chunks (an hour, a day, a block of
turns): the window runs inside a chunk, each chunk is summed up in one row, the summary rows are scanned per key, and
what a chunk needs from the ones before it is joined back. Where traffic comes in bursts, ``dealt`` makes chunks of a
number of rows; chunks of the clock follow the calendar, whatever the traffic.

``carry_forward`` and ``previous_row`` read their input twice, once for the rows and once for the summaries; on input
that is dear to make, such as parsed documents, give them a written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from donorlake.session import written

#: Rows of a chunk, about.
CHUNK_ROWS = 100_000


def _before(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(local: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    return local.join(summary, [key, "_chunk"], "left")


def dealt(df: DataFrame, key: str, order: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows with ``_chunk``: their range of (key, order), of about ``rows`` rows each, written out.

    A key that holds most rows, in an hour or a second, has as many ranges as it needs; a range may hold many small
    keys. Ranges are numbered in order. They come from a sample, which differs from run to run, so the dealt rows are
    written once and read from there.
    """
    parts = -(-max(df.count(), 1) // rows)
    ranged = df.repartitionByRange(parts, key, *order).withColumn("_chunk", F.spark_partition_id())
    return written(ranged, "chunks")


def carry_forward(
    df: DataFrame, key: str, order: Sequence[str], value: str, chunk: Column, out: str
) -> DataFrame:
    """Last non-null value at or before each row."""
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    seq = F.struct(*order)
    ends = chunked.groupBy(key, "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), seq)).alias("_end"))
    carries = ends.select(key, "_chunk", F.last("_end", ignorenulls=True).over(_before(key)).alias("_carry"))
    return (
        _with_carry(local, carries, key)
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_chunk", "_local", "_carry")
    )


def previous_row(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], chunk: Column, prefix: str = "previous_"
) -> DataFrame:
    """The given columns of the row before, as ``previous_*``; null on a key's first row."""
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    row = F.struct(*columns)
    local = chunked.withColumn("_local", F.lag(row).over(inside))
    ends = chunked.groupBy(key, "_chunk").agg(F.max_by(row, F.struct(*order)).alias("_end"))
    carries = ends.select(key, "_chunk", F.last("_end").over(_before(key)).alias("_carry"))
    before = F.coalesce(F.col("_local"), F.col("_carry"))
    return (
        _with_carry(local, carries, key)
        .withColumns({f"{prefix}{c}": before[c] for c in columns})
        .drop("_chunk", "_local", "_carry")
    )


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, chunk: Column) -> DataFrame:
    """Visits of a key: a pause longer than the gap starts a new one.

    Rows are first counted per key and second, ahead of any shuffle, so that no key has more rows than the clock has
    seconds. Seconds are then folded into visits inside a chunk, and only those pieces, a few per chunk, are put in
    order per key and joined where one chunk's last visit runs on into the next chunk.
    """
    if gap_seconds < 1:
        raise ValueError("a gap is at least a second")
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    seconds = df.groupBy(key, chunk.alias("_chunk"), F.date_trunc("second", F.col(time)).alias("_second")).agg(
        F.min(time).alias("_from"), F.max(time).alias("_to"), F.count("*").alias("_n")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy("_second")
    starts = F.coalesce((F.col("_from") - F.lag("_to").over(inside)) > gap, F.lit(False))
    pieces = (
        seconds.withColumn("_new", starts.cast("int"))
        .withColumn("_piece", F.sum("_new").over(inside))
        .groupBy(key, "_chunk", "_piece")
        .agg(F.min("_from").alias("started"), F.max("_to").alias("ended"), F.sum("_n").alias("n_events"))
    )
    along = Window.partitionBy(key).orderBy("started")
    fresh = F.coalesce((F.col("started") - F.lag("ended").over(along)) > gap, F.lit(True))
    return (
        pieces.withColumn("_fresh", fresh.cast("int"))
        .withColumn("session_no", F.sum("_fresh").over(along))
        .groupBy(key, "session_no")
        .agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n_events").alias("n_events"))
    )

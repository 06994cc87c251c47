"""A table that a stream adds to and that is read as if it had been built in one go.

Each micro-batch is folded on its own and written to the folder of its batch id, replacing whatever an earlier attempt
left there. Reading folds the folders together. The folds are associative, so the result does not depend on how the
input was cut into batches, and a batch that runs twice counts once. Nothing arrives too late to count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

Fold = Callable[[DataFrame], DataFrame]


class FoldedTable:
    """``fold`` turns rows into state, ``merge`` joins states, ``finish`` makes the final columns."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, merge: Fold, finish: Fold = lambda df: df):
        self.spark, self.path, self.fold, self.merge, self.finish = spark, path, fold, merge, finish

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def state(self, before: int | None = None) -> DataFrame:
        """The state of all batches, or of those ahead of one."""
        batches = self.spark.read.parquet(self.path)
        return self.merge((batches if before is None else batches.where(F.col("batch") < before)).drop("batch"))

    def read(self) -> DataFrame:
        return self.finish(self.state())

    def compact_into(self, path: str) -> FoldedTable:
        """The same table with all batches so far as one, for a stream to go on with."""
        self.state().write.mode("overwrite").parquet(f"{path}/batch=-1")
        return FoldedTable(self.spark, path, self.fold, self.merge, self.finish)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in twice as many partitions as tasks can run at once, at the most.

    Every partition writes files of each of its stores in every micro-batch, however few rows these have.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there now, one micro-batch after the other, and stop."""
    query = (
        stream.writeStream.foreachBatch(each_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_to_end(stream: DataFrame, form: str, path: str, checkpoint: str, *partitions: str) -> None:
    """Outbox: files that appear once each, whatever is retried. Later steps never wait for it."""
    writer = stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def read_table_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table as a stream, whether it is a folder of files or a single file.

    A stream may start at a folder or at a pattern, but not at one file, so the path is given as a pattern of itself.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)

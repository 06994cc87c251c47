"""What the operators share: words, the shared folder, whole-lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Between words: the space and the control characters 9 to 13. All other characters belong to words.
BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order. Null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without keeping them (BIGINT)."""
    text = F.coalesce(text, F.lit(""))
    outer = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(F.split(text, BLANK)) - outer).otherwise(0).cast("bigint")


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased; letters beyond ASCII stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as in tests, a
    folder of this machine is taken; on more than one machine that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_workers(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver did.

    On a cluster the package comes with ``--py-files`` or the image, as any other; the path is then of no effect.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder where all executors see it, next to the checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

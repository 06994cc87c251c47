"""Session settings and the shared folder that streams and written tables use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Partition counts and memory are left to the cluster: AQE merges small shuffle
# partitions and splits the skewed side of a sort-merge join.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A document that repeats a key is still a document; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Reading a document is one wide projection. Fused into a single method it is too large for the JVM to compile
    # (8000 bytes); above that size Spark is to split it into methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Can only be given when the session is made: a job here is many column expressions, and noting the Python line of
# each one for error messages costs more driver time than planning the job.
SESSION_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on to a session made elsewhere."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "donorlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_SETTINGS, **SESSION_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, for a job that reads them more than once and that are dear to make."""
    path = f"{shared_dir(df.sparkSession, purpose)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder; on a cluster a folder that one
    machine sees is an error, not a default.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="donorlake-")
    return f"{base.rstrip('/')}/donorlake/{purpose}-{uuid.uuid4().hex}"

"""Session settings this library relies on, and the place where lineage may be cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (time zone) or that let Spark re-plan at run time. Memory, executor
# counts and shuffle parallelism belong to the cluster and are left alone.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(app: str = "pleonasm", cpus: str | int = "*", memory: str = "16g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    parallelism = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def without_call_sites() -> None:
    """Stops this process from noting the line of Python behind every column expression.

    Noting it takes several calls into the JVM for each node; expressions here have thousands of nodes, so building a
    plan takes a minute instead of seconds. Sessions made here set `spark.python.sql.dataFrameDebugging.enabled` to
    false, which is the same. That setting cannot be changed in a session someone else has made, and only what it was
    read as can; where a release has no such place, nothing happens. Error messages lose the line, nothing else.
    """
    from pyspark.errors import utils

    if hasattr(utils, "_enable_debugging_cache"):
        utils._enable_debugging_cache = False


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one named by `spark.checkpoint.dir`.

    A temporary folder is used only where a session names none and runs in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pleonasm-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` reliably, so that a lost executor does not replay a long chain of stages."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

"""The request feed as a stream: reuse, windows, sessions, running state, upserts.

Every job reads a file stream, keeps its state under a watermark and writes a table to shared
storage. `run_available` drives a job over what is there and stops, which is how the batch check and
a scheduled catch-up run use it; the same DataFrame runs continuously with another trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pleonasm.operators.analytics import latest_per_key


def read_feed(spark: SparkSession, path: str, columns: dict[str, str], ts: str = "ts") -> DataFrame:
    """A stream of the parquet files under `path`, projected by SQL expressions.

    A feed of many files can be read in steps with the reader option `maxFilesPerTrigger`.
    """
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))
    return raw.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to `<path>/table` and read the table back; `<path>/state` keeps the progress.

    The next run over the same path goes on where this one stopped.
    """
    schema = stream.schema
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/table")


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they came after its watermark, over the progress it still reports."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def first_requests(feed: DataFrame, key: str, ts: str = "ts", horizon: str = "60 days") -> DataFrame:
    """One row per cache key within the horizon; every other arrival is a hit.

    The horizon must exceed the disorder of the files, or late first rows would be dropped.
    """
    return feed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key]).select(key)


def window_savings(
    feed: DataFrame, by: list[str], width: str, slide: str | None = None, ts: str = "ts", late: str = "1 hour"
) -> DataFrame:
    """Requests and tokens per window and group, written once a window is complete.

    Rows later than `late` are dropped and counted in `numRowsDroppedByWatermark` of the progress.
    """
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = feed.withWatermark(ts, late).groupBy(frame.alias("w"), *by).agg(
        F.count("*").alias("requests"), F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens")
    )
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "requests", "original_tokens", "optimized_tokens")


def user_sessions(feed: DataFrame, user: str, gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: requests less than `gap` apart, with their tokens."""
    grouped = feed.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(
        F.count("*").alias("requests"), F.sum("original_tokens").alias("tokens")
    )
    return grouped.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "requests", "tokens")


def running_hits(feed: DataFrame, path: str) -> DataFrame:
    """Hits and saved tokens per cache key so far, kept in a table below `path`.

    A count and a sum per key are an aggregation: a micro-batch adds its partial sums, a row for each key it has, and
    readers sum over the batches. A repeated batch overwrites itself, no key is ever forgotten and no state grows on
    the executors.
    """

    def totals(rows: DataFrame) -> DataFrame:
        saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens")).cast("long")
        return rows.groupBy("cache_key").agg(F.count("*").alias("requests"), F.sum(saved).alias("saved_tokens"))

    parts = _in_batches(feed, path, totals)
    summed = parts.groupBy("cache_key").agg(F.sum("requests").alias("requests"), F.sum("saved_tokens").alias("saved_tokens"))
    return summed.select("cache_key", (F.col("requests") - 1).alias("hits"), "saved_tokens")


def _in_batches(feed: DataFrame, path: str, of_batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `of_batch` makes of every micro-batch, each under its own number below `<path>/table`."""

    def write(batch: DataFrame, number: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = feed.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return feed.sparkSession.read.parquet(f"{path}/table").drop("batch")


def upsert_traces(feed: DataFrame, path: str, key: str, order: list[str]) -> DataFrame:
    """Insert-or-replace from a stream: the newest row of each key over all micro-batches.

    A batch writes its newest rows under its own number below `path`, so a repeated batch overwrites itself; readers
    take the newest row over the batches, and `merge_batches` folds them into one.
    """
    return latest_per_key(_in_batches(feed, path, lambda batch: latest_per_key(batch, key, order)), key, order)


def merge_batches(spark: SparkSession, path: str, target: str, key: str, order: list[str]) -> None:
    """Writes the newest row of each key over all batches below `<path>/table` as one table."""
    latest_per_key(spark.read.parquet(f"{path}/table").drop("batch"), key, order).write.mode("overwrite").parquet(target)

"""Chat payloads to message rows, trace and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = (
    "messages array<struct<role string, content string>>, compression_level string, provider string,"
    " mode string, model string, temperature double"
)


def normalise_payloads(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """One row per message of a JSON chat payload, with defaults for everything that is missing."""
    parsed = df.select(*keys, F.from_json(payload, PAYLOAD_SCHEMA).alias("_p"))
    rows = parsed.select(*keys, "_p", F.posexplode("_p.messages").alias("turn", "_m"))
    return rows.select(
        *keys,
        "turn",
        F.coalesce("_m.role", F.lit("user")).alias("role"),
        F.coalesce("_m.content", F.lit("")).alias("content"),
        F.coalesce("_p.compression_level", F.lit("safe")).alias("compression_level"),
        F.coalesce("_p.provider", F.lit("gemini")).alias("provider"),
        F.coalesce("_p.mode", F.lit("live")).alias("mode"),
        F.col("_p.model").alias("model"),
        F.coalesce("_p.temperature", F.lit(0.0)).alias("temperature"),
    )


def explode_messages(df: DataFrame, keys: list[str], messages: str = "messages") -> DataFrame:
    """Message rows from a column of (role, content) structs."""
    return df.select(*keys, F.posexplode(messages).alias("turn", "_m")).select(*keys, "turn", "_m.role", "_m.content")


def read_messages(spark, path: str, format: str = "parquet") -> DataFrame:
    """Rows with a `messages` array, from parquet or JSON lines."""
    schema = "request_id string, messages array<struct<role string, content string>>"
    return spark.read.schema(schema).format(format).load(path)


def write_traces(traces: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Trace log partitioned by day."""
    traces.withColumn("day", F.to_date(ts)).write.mode(mode).partitionBy("day").parquet(path)


def write_summary(report: DataFrame, path: str, format: str = "csv") -> None:
    """A small report table as one file."""
    writer = report.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)

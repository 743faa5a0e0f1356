"""Queries that run the request feed as a stream and compare it with a batch over the same rows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from pleonasm.catalog import query
from pleonasm.catalog import sqltext as S
from pleonasm.session import shared_folder
from pleonasm.sources.derived import DERIVED
from pleonasm.streaming import feed

_LOG = S.source("trace_log")


def _path(t) -> str:
    """A new folder in the one all executors share."""
    return f"{shared_folder(t.spark).rstrip('/')}/feed-{uuid4().hex}"


def _feed(t):
    # A glob fits a single file as well as a folder of files.
    columns = {**DERIVED["trace_log"].columns, "user_id": "user_id"}
    return feed.read_feed(t.spark, f"{t.folder}/events.parquet*", columns)


@query("S1", sql=f"WITH {_LOG} SELECT cache_key, count(*) - 1 AS hits FROM trace_log GROUP BY cache_key")
def stream_first_requests(t):
    firsts = feed.run_available(feed.first_requests(_feed(t), "cache_key"), _path(t))
    arrivals = t.derived("trace_log").groupBy("cache_key").agg(F.count("*").alias("_n"))
    seen = firsts.groupBy("cache_key").agg(F.count("*").alias("_f"))
    return arrivals.join(seen, "cache_key").select("cache_key", (F.col("_n") - F.col("_f")).alias("hits"))


_TOKENS = "count(*) AS requests, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(optimized_tokens) AS BIGINT) AS optimized_tokens"


@query(
    "S2",
    sql=f"""WITH {_LOG}, w AS (SELECT *, date_trunc('day', ts) AS ws, (SELECT max(ts) FROM trace_log) AS top FROM trace_log)
    SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, provider, {_TOKENS} FROM w WHERE ws + INTERVAL 1 DAY <= top - INTERVAL 1 HOUR GROUP BY ws, provider""",
)
def stream_daily_savings(t):
    daily = feed.run_available(feed.window_savings(_feed(t), ["provider"], "1 day"), _path(t))
    return daily.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "provider", "requests", "original_tokens", "optimized_tokens")


@query(
    "S2",
    sql=f"""WITH {_LOG}, w AS (SELECT *, unnest([date_trunc('day', ts) - INTERVAL 12 HOUR, date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 12 HOUR]) AS ws, (SELECT max(ts) FROM trace_log) AS top FROM trace_log)
    SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, {_TOKENS} FROM w WHERE ts >= ws AND ts < ws + INTERVAL 1 DAY AND ws + INTERVAL 1 DAY <= top - INTERVAL 1 HOUR GROUP BY ws""",
)
def stream_sliding_savings(t):
    sliding = feed.run_available(feed.window_savings(_feed(t), [], "1 day", "12 hours"), _path(t))
    return sliding.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "requests", "original_tokens", "optimized_tokens")


@query(
    "S3",
    sql=f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY cache_key ORDER BY ts, request_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM trace_log),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY cache_key ORDER BY ts, request_id) AS n FROM g)
    SELECT cache_key, strftime(min(ts), '%Y-%m-%d %H:%M') AS session_start, count(*) AS requests, CAST(sum(original_tokens) AS BIGINT) AS tokens FROM s GROUP BY cache_key, n
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM trace_log) - INTERVAL 1 HOUR""",
)
def stream_sessions(t):
    sessions = feed.run_available(feed.user_sessions(_feed(t), "cache_key", "6 hours"), _path(t))
    return sessions.select("cache_key", F.date_format("session_start", "yyyy-MM-dd HH:mm").alias("session_start"), "requests", "tokens")


@query("S4", sql=f"WITH {_LOG} SELECT cache_key, count(*) - 1 AS hits, CAST(sum(greatest(0, original_tokens - optimized_tokens)) AS BIGINT) AS saved_tokens FROM trace_log GROUP BY cache_key")
def stream_running_hits(t):
    return feed.running_hits(_feed(t), _path(t))


@query(
    "S6",
    sql=f"""WITH {_LOG} SELECT cache_key, request_id, original_tokens FROM trace_log QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, request_id DESC) = 1""",
)
def stream_upserted_traces(t):
    rows = _feed(t).select("cache_key", "request_id", "ts", "original_tokens")
    return feed.upsert_traces(rows, _path(t), "cache_key", ["ts", "request_id"]).select("cache_key", "request_id", "original_tokens")

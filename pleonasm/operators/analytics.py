"""Trace logs, response cache, roll-ups and readiness reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pleonasm import settings
from pleonasm.functions import text as T
from pleonasm.plans.savings import savings_percent


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert-or-replace: the newest row of each key. A partial aggregation, safe for a hot key."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_row"))
    return newest.select(key, "_row.*")


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n newest rows by `order`, newest first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def response_cache(traces: DataFrame, key: str = "cache_key", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Cache state after a log of requests: newest response, hits after the first, saved tokens."""
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens"))
    return traces.groupBy(key).agg(
        F.max_by("response", F.struct(ts, tie)).alias("response"),
        F.max_by(saved, F.struct(ts, tie)).alias("saved_tokens"),
        F.min(ts).alias("created_at"),
        (F.count("*") - 1).alias("hits"),
    )


def cache_statistics(cache: DataFrame) -> DataFrame:
    """Entries, hits, hit rate in percent, tokens saved."""
    return cache.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    ).withColumn(
        "hit_rate", F.round(F.col("hits") / F.greatest(F.lit(1), F.col("hits") + F.col("entries")) * 100, 2)
    )


def hit_ordinals(traces: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Per row: hits of its key so far and microseconds since the previous request of the key.

    A key that owns a third of the log would make one window partition of it. Rows are therefore
    numbered per key and hour, and one small row per key and hour carries the counts over.
    """
    staged = traces.withColumn("_slot", F.date_trunc("hour", F.col(ts)))
    slots = staged.groupBy(key, "_slot").agg(F.count("*").alias("_n"), F.max(ts).alias("_last"))
    over_slots = Window.partitionBy(key).orderBy("_slot")
    slots = slots.select(
        key,
        "_slot",
        F.coalesce(F.sum("_n").over(over_slots.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.lag("_last").over(over_slots).alias("_previous"),
    )
    inside = Window.partitionBy(key, "_slot").orderBy(ts, tie)
    numbered = staged.withColumn("_i", F.row_number().over(inside)).withColumn("_lag", F.lag(ts).over(inside))
    return (
        numbered.join(slots, [key, "_slot"])
        .withColumn("hits_so_far", F.col("_earlier") + F.col("_i") - 1)
        .withColumn("gap_us", F.unix_micros(ts) - F.unix_micros(F.coalesce("_lag", "_previous")))
        .drop("_slot", "_i", "_lag", "_earlier", "_previous")
    )


def trace_summary(traces: DataFrame, horizon: int | None = None) -> DataFrame:
    """Requests, tokens, savings, failures. `horizon` limits it to the newest traces."""
    rows = newest(traces, horizon, ["ts", "request_id"]) if horizon else traces
    totals = rows.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("original_tokens"),
        F.coalesce(F.sum("optimized_tokens"), F.lit(0)).alias("optimized_tokens"),
        F.count_if(~F.col("accepted")).alias("quality_failures"),
        F.count_if(~F.col("facts_kept")).alias("protected_failures"),
        F.round(F.sum("total_savings"), 6).alias("cost_saved"),
    )
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens"))
    return totals.withColumn("tokens_saved", saved).withColumn(
        "savings_percent", F.round(saved / F.greatest(F.lit(1), F.col("original_tokens")) * 100, 2)
    )


def _outcome_totals() -> list[Column]:
    return [
        F.count("*").alias("cases"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("optimized_tokens").alias("optimized_tokens"),
        F.count_if(~F.col("facts_kept")).alias("protected_failures"),
        F.count_if(F.col("similarity") < settings.BENCHMARK_SIMILARITY).alias("semantic_failures"),
        F.round(F.sum("total_savings"), 6).alias("cost_saved"),
    ]


def _with_savings(df: DataFrame) -> DataFrame:
    return df.withColumn("savings_percent", savings_percent(F.col("original_tokens"), F.col("optimized_tokens")))


def benchmark_table(cases: DataFrame) -> DataFrame:
    """Suite and category rows with suite totals and the grand total; `level` is 0, 1 or 3."""
    grouped = cases.rollup("suite", "category").agg(F.grouping_id().cast("int").alias("level"), *_outcome_totals())
    return _with_savings(grouped)


def savings_cube(traces: DataFrame) -> DataFrame:
    """Savings by provider, by level, by both and overall."""
    grouped = traces.cube("provider", "level").agg(
        F.grouping_id().cast("int").alias("grouping"),
        F.count("*").alias("requests"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("optimized_tokens").alias("optimized_tokens"),
    )
    return _with_savings(grouped)


def robustness_table(cases: DataFrame) -> DataFrame:
    """Per case kind: tokens, accepted and failed runs."""
    grouped = cases.groupBy("category").agg(
        F.count("*").alias("runs"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("optimized_tokens").alias("optimized_tokens"),
        F.count_if("accepted").alias("accepted_runs"),
        F.count_if(~F.col("facts_kept")).alias("failures"),
    )
    return _with_savings(grouped)


def outcome_by_category(cases: DataFrame) -> DataFrame:
    """Totals, failures, runs without reduction, mean savings, failure rate."""
    saving = savings_percent(F.col("original_tokens"), F.col("optimized_tokens"))
    failed = ~F.col("accepted") | ~F.col("facts_kept")
    return cases.groupBy("category").agg(
        F.count("*").alias("total"),
        F.count_if(failed).alias("failures"),
        F.count_if(F.col("optimized_tokens") >= F.col("original_tokens")).alias("no_reduction"),
        F.round(F.avg(saving), 2).alias("mean_savings"),
        F.round(F.count_if(failed) / F.count("*"), 4).alias("failure_rate"),
    )


def first_examples(cases: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows per group. Spark prunes to k rows per task before it shuffles them."""
    ranked = cases.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_n") <= k).drop("_n")


def readiness(summary: DataFrame, live: bool = False) -> DataFrame:
    """Score and label from one row with savings_percent, quality_failures, robustness_failures, hit_rate."""
    score = (
        F.lit(55.0)
        + F.least(F.lit(20.0), F.col("savings_percent"))
        - F.col("quality_failures") * 10
        - F.col("robustness_failures") * 4
        + F.least(F.lit(10.0), F.col("hit_rate") / 10)
        + F.lit(10.0 if live else 0.0)
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0 if live else 85.0), F.round(score, 0))).cast("int")
    label = T.first_match(
        [(F.col("score") >= 90, "pilot_ready"), (F.col("score") >= 75, "staging_only"), (F.col("score") >= 50, "prototype_only")],
        "unsafe",
    )
    return summary.withColumn("score", bounded).withColumn("recommendation", label)


def rollout_flags(scored: DataFrame, live: bool = False) -> DataFrame:
    return (
        scored.withColumn("recommended_level", F.lit("safe"))
        .withColumn("live_test_needed", F.lit(not live))
        .withColumn("staging_safe", F.col("score") >= 75)
        .withColumn("production_blocked", F.lit(not live) | (F.col("score") < 90))
    )


def quality_rows(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Word overlap, kept numbers, length difference and kept code fences of a rewrite."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != ""))
    numbers = lambda c: F.array_distinct(T.find_all(F.col(c), r"\b\d+(?:\.\d+)?\b"))
    fence = lambda c: F.contains(F.col(c), F.lit("```"))
    return (
        df.withColumn("answer_similarity", F.round(T.jaccard(words(before), words(after)), 3))
        .withColumn("numbers_kept", F.size(F.array_except(numbers(before), numbers(after))) == 0)
        .withColumn("length_difference", F.length(after) - F.length(before))
        .withColumn("code_kept", ~fence(before) | fence(after))
    )


def conversation_acceptance(messages: DataFrame, conversation: str) -> DataFrame:
    """A conversation is rewritten as a whole or not at all.

    `messages` carries before/after tokens, the gate result, the similarity and the stage used.
    """
    summed = messages.groupBy(conversation).agg(
        F.sum("before_tokens").alias("original_tokens"),
        F.sum("after_tokens").alias("_after"),
        F.bool_and("gate_passed").alias("_ok"),
        F.min("similarity").alias("min_similarity"),
        F.array_join(F.array_sort(F.collect_set("stage")), "|").alias("stages"),
    )
    accepted = F.col("_ok") & (F.col("_after") < F.col("original_tokens"))
    return (
        summed.withColumn("accepted", accepted)
        .withColumn("optimized_tokens", F.when(accepted, F.col("_after")).otherwise(F.col("original_tokens")))
        .withColumn("savings_percent", savings_percent(F.col("original_tokens"), F.col("optimized_tokens")))
        .drop("_after", "_ok")
    )

"""Prices and savings in money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pleonasm import lexicons as L


def price_table(spark: SparkSession) -> DataFrame:
    """Four fixed price keys; small by construction, so it may be broadcast."""
    return spark.createDataFrame(list(L.PRICES), "price_key string, input_per_1k double, output_per_1k double")


def price_key(provider: Column, model: Column) -> Column:
    """Price key by exact model name: a small model is never priced as a strong one."""
    name = F.lower(F.coalesce(model, F.lit("")))
    small = name.rlike(r"mini|nano|small")
    strong = name.rlike(r"strong|gpt-4|o3") & ~small
    return (
        F.when(provider == "dry-run", F.lit("dry-run"))
        .when((provider == "openai") & strong, F.lit("openai-strong"))
        .when(provider == "openai", F.lit("openai-small"))
        .otherwise(F.lit("gemini-flash"))
    )


def with_prices(df: DataFrame, provider: str = "provider", model: str = "model") -> DataFrame:
    keyed = df.withColumn("price_key", price_key(F.col(provider), F.col(model)))
    return keyed.join(F.broadcast(price_table(df.sparkSession)), "price_key", "left")


def micro(amount: Column) -> Column:
    """Money rounded half up to six decimals, with the same result on every engine."""
    return F.floor(amount * 1e6 + 0.5) / F.lit(1e6)


def _cost(tokens: str, rate: str) -> Column:
    return micro(F.col(tokens) / 1000 * F.col(rate))


def with_cost_report(
    df: DataFrame, before: str = "original_tokens", after: str = "optimized_tokens", cache_hit: str | None = None
) -> DataFrame:
    """Cost before and after from input tokens only, and what compression and cache hits save."""
    priced = (
        with_prices(df)
        .withColumn("cost_before", _cost(before, "input_per_1k"))
        .withColumn("cost_after", _cost(after, "input_per_1k"))
    )
    hit = F.col(cache_hit) if cache_hit else F.lit(False)
    compression = micro(F.greatest(F.lit(0.0), F.col("cost_before") - F.col("cost_after")))
    return (
        priced.withColumn("compression_savings", compression)
        .withColumn("cache_savings", F.when(hit, F.col("cost_after")).otherwise(F.lit(0.0)))
        .withColumn("total_savings", micro(F.col("compression_savings") + F.col("cache_savings")))
        .drop("input_per_1k", "output_per_1k")
    )


def with_live_cost_report(
    df: DataFrame, before: str = "original_tokens", after: str = "optimized_tokens", output: str = "output_tokens",
    provider_prompt: str | None = None,
) -> DataFrame:
    """The same with the answer's tokens; the provider's own prompt count wins where it is known."""
    priced = with_prices(df).withColumn("_out", F.col(output) / 1000 * F.col("output_per_1k"))
    prompt = F.coalesce(F.col(provider_prompt), F.col(after)) if provider_prompt else F.col(after)
    total = lambda tokens: micro(tokens / 1000 * F.col("input_per_1k") + F.col("_out"))
    return (
        priced.withColumn("cost_before", total(F.col(before)))
        .withColumn("cost_after", total(F.col(after)))
        .withColumn("cost_actual", total(prompt))
        .withColumn("output_cost", micro(F.col("_out")))
        .withColumn("compression_savings", micro(F.greatest(F.lit(0.0), F.col("cost_before") - F.col("cost_after"))))
        .drop("input_per_1k", "output_per_1k", "_out")
    )

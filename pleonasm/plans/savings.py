"""What a rewrite saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pleonasm.functions import text as T
from pleonasm.operators import dedupe


def savings_percent(before: Column, after: Column) -> Column:
    """Share of tokens saved in percent with two decimals; 0 for an empty original."""
    share = (before - after) / F.when(before > 0, before) * 100
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def keep_first_savings(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Tokens before and after dropping repeated sentences inside each text, per group.

    One scan and one shuffle of partial sums: the repeats of a text are found inside its row.
    """
    kept = dedupe.with_kept_sentences(df.select(*by, text), text, key="squeezed", pattern=T.SPLIT_TERMINAL_OR_LINE)
    before = T.count_tokens(F.col(text))
    sized = kept.select(
        *by,
        "dropped_sentences",
        before.alias("_before"),
        F.when(F.col("dropped_sentences") == 0, before).otherwise(T.count_tokens(F.col("kept_text"))).alias("_after"),
    )
    totals = sized.groupBy(*by).agg(
        F.count("*").alias("texts"),
        F.sum("dropped_sentences").cast("long").alias("dropped_sentences"),
        F.sum("_before").alias("original_tokens"),
        F.sum("_after").alias("optimized_tokens"),
    )
    return totals.withColumn("savings_percent", savings_percent(F.col("original_tokens"), F.col("optimized_tokens")))

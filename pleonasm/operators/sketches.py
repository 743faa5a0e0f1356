"""Profiles of a corpus as rows that can be added up: sketches of distinct sentences and counts of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pleonasm.functions import text as T

#: Registers of a sketch are 2**LOG_REGISTERS; its error is about 1.04 over the root of that, one time in three more.
LOG_REGISTERS = 14
BOUND = 0.03


def sentence_profiles(sentences: DataFrame, by: list[str]) -> DataFrame:
    """(by, sentences, distinct_sketch, sizes): what a later report needs of the sentences of a group.

    `sizes` maps a token count to the number of sentences of it. Rows are small whatever the group holds, and rows of any
    groups can be merged without reading a text again. Null sentences count as none.
    """
    sized = sentences.filter(F.col("sentence").isNotNull()).withColumn("_size", T.count_tokens(F.col("sentence")))
    cells = sized.groupBy(*by, "_size").agg(F.count("*").alias("_n"), F.hll_sketch_agg("sentence", LOG_REGISTERS).alias("_h"))
    sizes = F.map_from_entries(F.sort_array(F.collect_list(F.struct("_size", "_n"))))
    return cells.groupBy(*by).agg(F.sum("_n").alias("sentences"), F.hll_union_agg("_h").alias("distinct_sketch"), sizes.alias("sizes"))


def merged_profiles(profiles: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, sentences, about_distinct, one column of tokens for each share): profiles added up over all other columns.

    The count of distinct sentences is an estimate; token counts at a share (the least that so many sentences do not
    exceed) are exact.
    """
    whole = profiles.groupBy(*by).agg(F.sum("sentences").alias("sentences"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("about_distinct"))
    sizes = profiles.select(*by, F.explode("sizes").alias("size", "n")).groupBy(*by, "size").agg(F.sum("n").alias("n"))
    below = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("size"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    at = [F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("size"))).alias(f"tokens_{round(100 * q)}") for q in shares]
    return whole.join(below.groupBy(*by).agg(*at), by)

"""Parquet tables of one folder, opened lazily, and the inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pleonasm.session import without_call_sites


def spread_small(table: DataFrame) -> DataFrame:
    """`table` over as many partitions as the session has cores, if it has less than a file split or a file for each of them.

    Work on one text is heavy here, and a file of one row group is read by one task whatever its splits. Tables of more
    than that come in enough splits and are not shuffled, nor are tables of as many files.

    Spark moves filters below a repartition, with all the expressions they are made of: what a text is filtered by would
    be worked out by the few tasks that read the file. The filter behind it holds for every row, and since it is not
    deterministic no other filter is moved past it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    split = table.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(table.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= split * cores or len(table.inputFiles()) >= cores:
        return table
    return table.repartition(cores).filter(F.spark_partition_id() >= 0)


class Tables:
    """`tables.orders` reads `<folder>/orders.parquet`; nothing is read before an action runs.

    With `spread`, tables of less than a file split per core are dealt to all cores, as a small file is one task.
    """

    def __init__(self, spark: SparkSession, folder: str, spread: bool = False) -> None:
        without_call_sites()
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.spread = spread

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread_small(table) if self.spread else table

    def derived(self, name: str) -> DataFrame:
        """An input built from a table by expressions both engines understand."""
        from pleonasm.sources.derived import DERIVED

        source = DERIVED[name]
        table = getattr(self, source.table)
        if source.table == "events":
            table = table.withColumn("ts", F.col("ts").cast("timestamp"))
        if source.where:
            table = table.where(source.where)
        return table.selectExpr(*[f"{expression} AS {column}" for column, expression in source.columns.items()])

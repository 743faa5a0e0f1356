"""Tables that an operator writes for itself in the folder all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from pleonasm.session import shared_folder


class Scratch:
    """A folder of its own for the tables of one run: each is a restart point, read as often as needed.

    What is not needed any more is dropped by its writer; the table a result reads stays as long as the folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def write(self, df: DataFrame, table: str, *partitions: str) -> DataFrame:
        """Writes `df` and reads it back with the schema it had."""
        df.write.partitionBy(*partitions).parquet(self.path(table))
        return self.read(table)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def _place(self, table: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, table: str) -> bool:
        system, path = self._place(table)
        return system.exists(path)

    def drop(self, table: str) -> None:
        system, path = self._place(table)
        system.delete(path, True)

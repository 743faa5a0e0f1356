"""A table with one row per key that takes batches of changes and rewrites only what they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Insert-or-replace on files: rows are kept in `parts` partitions by the hash of their key.

    `newest` names the columns that order the versions of a row: the greatest one replaces the others. Columns in
    `added` are summed over all versions (a row of a batch adds what it has), those in `first` keep their least value.
    A batch is reduced to one row per key before it is shuffled, so a key that fills a third of a batch is no hot key.
    Only partitions that hold a key of the batch are read and written; the files of the others stay as they are.

    A batch has a number, which every partition it touched remembers. A batch that is run again, whole or after it was
    stopped half-way, leaves alone what has it already, so sums do not count twice. Batches must come in the order of
    their numbers. Rows of a null key are one row like any other.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, newest: list[str], added: tuple[str, ...] = (), first: tuple[str, ...] = (), parts: int = 64) -> None:
        self.spark, self.path, self.key, self.newest, self.added, self.first, self.parts = spark, path.rstrip("/"), key, newest, added, first, parts

    def _exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/table")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/table")

    def read(self) -> DataFrame:
        """The rows as they are now."""
        return self._stored().drop("part", "batch")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        plain = [c for c in rows.columns if c not in (self.key, *self.added, *self.first)]
        order = F.struct(*self.newest)
        taken = rows.groupBy(self.key).agg(
            F.max_by(F.struct(*plain), order).alias("_row"), *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in self.added], *[F.min(c).alias(c) for c in self.first]
        )
        return taken.select(*[F.col(f"_row.{c}").alias(c) if c in plain else F.col(c) for c in rows.columns])

    def merge(self, rows: DataFrame, number: int) -> None:
        """Takes the rows of batch `number` in."""
        staged = f"{self.path}/staged/{number}"
        changes = self._one_per_key(rows).withColumn("part", self._part())
        if self._exists():
            changes.write.mode("overwrite").parquet(f"{staged}/changes")
            changes = self.spark.read.parquet(f"{staged}/changes")
            stored = self._stored()
            done = stored.filter(F.col("batch") >= number).select("part").distinct()
            fresh = changes.join(F.broadcast(done), "part", "left_anti")
            touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most `parts` numbers
            held = stored.filter(F.col("part").isin(touched)).select(*rows.columns)
            changes = self._one_per_key(held.unionByName(fresh.select(*rows.columns))).withColumn("part", self._part())
        whole = changes.withColumn("batch", F.lit(number).cast("long"))
        # Written beside the table first: the files that are read must not be replaced meanwhile.
        whole.write.mode("overwrite").parquet(f"{staged}/merged")
        merged = self.spark.read.parquet(f"{staged}/merged").repartition(self.parts, "part")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/table")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/staged")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def cache_entries(log: DataFrame, key: str = "cache_key", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """What each request of a log does to the response cache, as rows of a `KeyedTable`."""
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("optimized_tokens")).cast("long")
    return log.select(key, ts, tie, "response", saved.alias("saved_tokens"), F.col(ts).alias("created_at"), F.lit(1).cast("long").alias("requests"))


def response_cache_table(spark: SparkSession, path: str) -> KeyedTable:
    """The response cache: the newest response of a key, when it was first stored, how often it was asked for."""
    return KeyedTable(spark, path, "cache_key", ["ts", "request_id"], added=("requests",), first=("created_at",))


def trace_table(spark: SparkSession, path: str) -> KeyedTable:
    """The trace log: a trace written again replaces the one of its request."""
    return KeyedTable(spark, path, "request_id", ["ts"])

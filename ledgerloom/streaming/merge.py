"""Merging streams into a table of files, so that a batch that is run again changes nothing.

The table is dealt to buckets by its key. Each micro-batch writes new versions of the buckets it touches, below its own
number, and then commits a log row for each bucket that tells which batch wrote its newest version. Data
without a log row do not count: a batch that was killed between writing and committing is run again by the
stream with the same number, and overwrites what it had written. A batch that is committed is never applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.sinks import upsert

BUCKETS = 16


class MergedTable:
    """A table at ``path`` with one row a ``key``; ``human`` columns are only ever filled in by people."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], human: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.human, self.buckets = spark, path, key, human, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _versions(self) -> tuple[int, dict[int, int]]:
        """The last committed batch (-1 without) and, of each bucket, the batch of its newest version: ``buckets`` rows at most."""
        log = self.spark.read.schema("bucket int, version long, batch long").option("recursiveFileLookup", True).parquet(f"{self.path}/log") if self._has_log() else None
        if log is None:
            return -1, {}
        last = log.agg(F.max("batch")).first()[0]
        return last, {r["bucket"]: r["version"] for r in log.filter(F.col("batch") == last).collect() if r["bucket"] is not None}

    def _has_log(self) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(root) and bool(files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/batch=*/_SUCCESS")))

    def _read(self, buckets: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={v}/bucket={b}" for b, v in sorted(buckets.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The table as of the last committed batch."""
        return self._read(self._versions()[1])

    def apply(self, batch: DataFrame, number: int, order: str) -> None:
        """Merges the rows of a batch, the last by ``order`` of each key; see the module."""
        done, versions = self._versions()
        if number <= done:
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        latest = Window.partitionBy(*self.key).orderBy(F.desc(order))
        new = batch.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select(*self.schema.fieldNames())
        touched = {r[0] for r in new.select(bucket).distinct().collect()}
        self.write(new, touched, versions, number, order)
        self.commit(versions | dict.fromkeys(touched, number), number)

    def write(self, new: DataFrame, touched: set[int], versions: dict[int, int], number: int, order: str) -> None:
        """New versions of the touched buckets; a row that is older than the table's own changes nothing."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        old = self._read({b: v for b, v in versions.items() if b in touched})
        newer = new.join(old.select(*self.key, F.col(order).alias("_was")), self.key, "left").filter(F.col("_was").isNull() | (F.col(order) >= F.col("_was"))).drop("_was")
        merged = upsert(old, newer, self.key, self.human).select(*self.schema.fieldNames())
        merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")

    def commit(self, versions: dict[int, int], number: int) -> None:
        rows = [(b, v, number) for b, v in sorted(versions.items())] or [(None, None, number)]
        self.spark.createDataFrame(rows, "bucket int, version long, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")


def merged(stream: DataFrame, table: MergedTable, order: str, checkpoint: str, first: int = 0) -> DataFrame:
    """Runs a stream over what is there now into ``table`` and gives its rows; its batches are numbered from ``first`` on."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: table.apply(df, first + n, order)).start()
    query.awaitTermination()
    return table.rows()


def routed(stream: DataFrame, path: str, checkpoint: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Events in time, and those more than ``days`` before the latest event of earlier batches, in two tables of one query.

    A batch writes both below its own number and then the latest event seen; run again, it overwrites them.
    """
    spark = stream.sparkSession
    log = MergedTable(spark, path, "bucket int", [], [])

    def apply(df: DataFrame, number: int) -> None:
        seen = spark.read.schema("seen timestamp, batch long").option("recursiveFileLookup", True).parquet(f"{path}/log") if log._has_log() else None
        last = seen.filter(F.col("batch") < number).agg(F.max("seen")).first()[0] if seen is not None else None
        edge = F.lit(last).cast("timestamp") - F.expr(f"interval {days} days")
        late = F.coalesce(F.col("ts") < edge, F.lit(False))
        for name, rows in (("in_time", df.filter(~late)), ("late", df.filter(late))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        now = df.agg(F.greatest(F.max("ts"), F.lit(last).cast("timestamp")).alias("seen"), F.lit(number).cast("long").alias("batch"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
    read = lambda name: spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/{name}")
    return read("in_time"), read("late")

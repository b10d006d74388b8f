"""Incremental manifests: file streams merged batch by batch (T1-T4), and a windowed failure rate (T5).

A table lies in folders by the hash of its keys. A batch reads and rewrites only
the folders that its keys fall in, by Spark's dynamic partition overwrite, so
what is written follows the batch and not the table. Merging a batch into rows
that it was merged into already changes nothing, so a batch that runs again,
after whatever it had written, gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import manifests

#: Folders of a table. A table's number is fixed when it is first written.
BUCKETS = 64


class KeyedTable:
    """A Parquet table by `bucket`, the hash of its keys."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Callable[[], tuple[Column, ...]], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _exists(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys()), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some folders, of which only these are read."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*self.schema.fieldNames())

    def fold(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merges a batch with combine(existing, batch); the folders that it wrote."""
        batch = batch.select(*self.schema.fieldNames())
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())
        if touched:
            merged = combine(self.read(touched), batch).select(*self.schema.fieldNames())
            dealt = merged.withColumn("bucket", self.bucket()).repartition("bucket")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched


def run_into(stream: DataFrame, target: KeyedTable, combine: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, available_now: bool = True):
    """Starts a query that folds each batch into `target` with combine(existing, batch), which must give the same for a batch that comes again."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: target.fold(batch, combine) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged_table(spark: SparkSession, target: str, schema: T.StructType, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, target, schema, manifests.merge_key, buckets)


def upserted_table(spark: SparkSession, target: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, target, schema, lambda: (F.col(key).cast("string"),), buckets)


def merge_stream(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str):
    """Manifest files as they arrive, merged by priority."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return run_into(stream, merged_table(spark, target, schema), manifests.merge, checkpoint)


def upsert_stream(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, key: str):
    """Manifest files as they arrive, the last row of a key winning."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return run_into(stream, upserted_table(spark, target, schema, key), lambda a, b: manifests.upsert(a, b, key), checkpoint)


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen before, within the watermark if a time column is named (T4)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def failure_rate(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Share of error events in each window, late rows within `delay` included (T5)."""
    window = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(window.alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("start"), "events", "errors")

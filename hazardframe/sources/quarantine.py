"""Setting files aside: moves planned as a table, then done through the store, so that a run that was cut off goes on (K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plan(files: DataFrame, folder: str) -> DataFrame:
    """(path, target): where each file would go, its name kept; of two with one name the second's gets a digest of its path."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name")).distinct()
    first = rows.groupBy("name").agg(F.min("path").alias("first"))
    other = F.when(F.col("path") == F.col("first"), F.col("name")).otherwise(F.concat(F.substring(F.sha2("path", 256), 1, 12), F.lit("-"), "name"))
    return rows.join(first, "name").select("path", F.concat(F.lit(folder.rstrip("/") + "/"), other).alias("target"))


def run(spark: SparkSession, files: DataFrame, folder: str, record: str, dry_run: bool = False) -> dict[str, int]:
    """Moves `files` (path) into `folder`; counts by outcome: moved, done before, missing, failed, or planned for a dry run.

    The plan is written under `record` before the first move, and read instead of
    made where it is there already, so a second run finishes what a first one
    planned. A file that is gone while its target stands was moved before. Moves
    are renames in the store, one file at a time; the plan is read in pieces.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(folder).getFileSystem(conf)
    moves = plan(files, folder)
    if dry_run:
        return {"planned": moves.count()}
    if not store.exists(at(f"{record}/_SUCCESS")):
        moves.write.mode("overwrite").parquet(record)
    store.mkdirs(at(folder))
    out: dict[str, int] = {}
    for row in spark.read.parquet(record).toLocalIterator():
        here, there = store.exists(at(row.path)), store.exists(at(row.target))
        if not here:
            said = "done before" if there else "missing"
        else:
            said = "moved" if not there and store.rename(at(row.path), at(row.target)) else "failed"
        out[said] = out.get(said, 0) + 1
    return out

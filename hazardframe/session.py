"""Session settings that the operators rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Adaptive execution sizes shuffles and splits skewed joins at run time; nothing here depends on a fixed partition count.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "hazardframe", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    return (builder.master(master) if master else builder).getOrCreate()


_FOLDERS: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for tables of one run, in the store that spark.checkpoint.dir names; it goes when the process ends. Only a local master may leave the setting unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="hazardframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/hazardframe/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more, in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_folders() -> None:
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            if spark.sparkContext._jsc is not None:
                drop_folder(spark, path)
        except Exception:  # the JVM may be gone when the process ends
            return

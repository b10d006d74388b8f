"""Helpers that the operators share: clashing columns, scratch tables, batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` less the columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def quoted(name: str) -> str:
    """The name as Spark reads it whole, dots included."""
    return "`" + name.replace("`", "``") + "`"


def all_of(df: DataFrame) -> list:
    """Every column of `df`, whatever its name."""
    return [F.col(quoted(c)) for c in df.columns]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset, as in local tests, a folder of this process is
    taken; on a cluster the setting must name a store that all machines reach.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="hazardframe-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_OPEN: list[Scratch] = []


def release(since: int = 0) -> None:
    """Closes every scratch opened after the first `since`, once the result that reads them is written."""
    while len(_OPEN) > since:
        _OPEN.pop().close()


def opened() -> int:
    return len(_OPEN)


atexit.register(release)


class Scratch:
    """Tables written under the shared folder; lineage ends at each of them.

    A written table survives the loss of any executor, unlike cached blocks.
    `drop` frees one early, `close` all; `release` closes what a finished step
    opened, and what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/hazardframe/{label}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone when the process ends
            if name:
                raise

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop()


def hash_sample(df: DataFrame, keys: list[str], size: int, seed: int, distinct: bool = False) -> DataFrame:
    """The `size` rows with the least seeded hashes of `keys`, or all if there are fewer; with `distinct`, of distinct rows.

    A count sets a cutoff that leaves a little more than `size` rows, so the
    final order and limit move a bounded number of rows however many partitions
    there are. The result does not depend on partitioning. Equal rows have one
    hash, so distinct ones are made after the cutoff and a hot row costs nothing.
    """
    n = df.select(F.approx_count_distinct(F.xxhash64(*keys), 0.02)).head()[0] if distinct else df.count()
    hashed = df.withColumn("__o", F.xxhash64(F.lit(seed), *keys))
    share = (size * (1.2 if distinct else 1.0) + 8 * size**0.5 + 100) / max(n, 1)
    if share < 0.5:
        hashed = hashed.where(F.col("__o") < F.lit(int(-(1 << 63) + share * (1 << 64))))
    if distinct:
        hashed = hashed.distinct()
    return hashed.orderBy("__o", *keys).limit(size).drop("__o")


#: Rows of one key that a task of a join gets at most, about, and the most keys above that which are broadcast (some 100 bytes each).
OFTEN, OFTEN_MOST = 10_000, 500_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join (`inner` or `left`) of `left` with one row a key, in which very common keys are dealt over many tasks.

    counts: a written table of `on` and `n`, the rows of `left` that have the
    key. Keys with more than `OFTEN` rows are counted first, and the `OFTEN_MOST`
    most common of them are dealt: their list goes to the left rows, each of which
    gets a salt from its own number, and the right row is repeated as often. Rows
    equal in every column get different numbers. `left` must be read from tables by
    narrow steps alone, so that a task that runs again numbers its rows as before.
    `hint` names a join strategy for the right side, where the plan is to be alike at every size.
    """
    hinted = (lambda df: df.hint(hint)) if hint else (lambda df: df)
    often = counts.where(F.col("n") > OFTEN)
    found = often.count()
    if not found:
        return left.join(hinted(right), on, how)
    if found > OFTEN_MOST:
        often = often.orderBy(F.col("n").desc(), *on).limit(OFTEN_MOST)
    hot, parts = F.broadcast(often.select(*on, F.ceil(F.col("n") / OFTEN).cast("int").alias("__s"))), F.coalesce("__s", F.lit(1))
    numbered = left.withColumn("__row", F.monotonically_increasing_id())
    mine = numbered.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64("__row"), parts).cast("int")).drop("__s", "__row")
    theirs = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__s")
    return mine.join(hinted(theirs), [*on, "__salt"], how).drop("__salt")


def hand_back() -> None:
    """Gives memory that this Python worker no longer uses back to the machine.

    Workers outlive their tasks and wait for the next stage; without this, several
    of them would keep the most that each ever held.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidy(run):
    """A function over the batches of a partition that hands memory back when the partition is done."""

    def wrapped(batches, *args):
        try:
            yield from run(batches, *args)
        finally:
            hand_back()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]

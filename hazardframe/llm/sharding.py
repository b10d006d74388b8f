"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records over memory-sized buckets by a seeded hash of the
whole record; pass two gathers each bucket, puts it in the order of a seeded
Fisher-Yates permutation (Spark's `shuffle`) and writes it. The concatenated
buckets are one random order of all rows, and shards are equal ranges of it:
row counts differ by one at most (law `rows`), whatever key or source is hot,
because no shard boundary depends on a key.

The seed fixes which bucket a record goes to. The permutation of a bucket is
drawn by the task attempt that writes it, and only committed files are read, so
a lost executor changes nothing that was read before.

Rows that are equal in every column hash alike. Where they would fill more than
a part of a bucket they are numbered first, in a written table, and the number
enters the hash, so a third of all rows may be copies of one.

Defined results: nulls in any column hash like a value; a null text has size 8
and the checksum of no bytes. An empty table gives an empty result. Columns
named like the outputs are replaced; any other name is allowed, as a record
travels in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, all_of, quoted, text_or_empty, without

#: Bytes of records, as counted by `size`, that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Buckets that a task gathers, on average, once there are more of them than shuffle partitions.
TASK_BUCKETS = 8
SEED = 20240229
OUTPUTS = ["size", "shard", "slot", "law", "grown_shard", "text_crc32"]


def record_hash(docs: DataFrame, seed: int):
    """A seeded hash of whole records; maps, which do not hash, are left out."""
    columns = [F.col(quoted(c)) for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    return F.xxhash64(F.lit(seed), *columns)


def scattered(docs: DataFrame, text_col: str, bucket_bytes: int, seed: int, scratch: Scratch) -> DataFrame:
    """(bucket, row): the records as structs, each in its bucket, buckets dealt so that a task holds few of them.

    One narrow aggregate by record hash gives the number of buckets and the
    records that repeat for more than a quarter of a bucket; of these there are
    fewer than four for each bucket.
    """
    size = F.octet_length(text_or_empty(text_col)).cast("long") + F.lit(8)
    row = docs.select(F.struct(*all_of(docs)).alias("row"), record_hash(docs, seed).alias("mark"), size.alias("size"))
    marks = row.groupBy("mark").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    marks = marks.agg(F.sum("m").alias("m"), F.count_if((F.col("n") > 1) & (F.col("m") > bucket_bytes / 4)).alias("hot")).head()
    buckets = max(1, math.ceil((marks["m"] or 0) / bucket_bytes))
    cold, salted = row, None
    if marks["hot"]:
        hot = row.groupBy("mark").agg(F.count("*").alias("n"), F.sum("size").alias("m")).where((F.col("n") > 1) & (F.col("m") > bucket_bytes / 4)).select("mark")
        hot = scratch.table(hot, "hot")
        cold = row.join(hot, "mark", "left_anti")
        # numbered when written: a task that runs again reads the same numbers
        copies = scratch.table(row.join(hot, "mark", "left_semi").select("row", "mark", F.monotonically_increasing_id().alias("copy")), "copies")
        salted = copies.select("row", F.xxhash64(F.lit(seed), "mark", "copy").alias("mark"))
    out = cold.select("row", "mark")
    out = out.union(salted) if salted is not None else out
    parts = max(math.ceil(buckets / TASK_BUCKETS), min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return out.select(F.pmod("mark", F.lit(buckets)).alias("bucket"), "row").repartition(parts, "bucket")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes the shuffled records under `path` and returns them with size, shard and slot.

    The files hold (bucket, pos, record), pos counting from 0 in each bucket's
    permutation; the position of a bucket's first row follows from the counts of
    the buckets before it, one number for each, which a window over the written
    files adds up.
    """
    spark = docs.sparkSession
    docs = without(docs, OUTPUTS)
    gathered = scattered(docs, text_col, bucket_bytes, seed, Scratch(spark, "scatter")).groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    shuffled = gathered.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
    shuffled.select("bucket", F.col("pos").cast("long").alias("pos"), "row").write.option("compression", "zstd").parquet(path)
    placed = assign_shards(spark.read.parquet(path), n_shards).select("row.*", "shard", "slot")
    return placed.withColumn("size", F.octet_length(text_or_empty(text_col)).cast("long") + F.lit(8))


def assign_shards(written: DataFrame, n_shards: int) -> DataFrame:
    """Shard and slot of written rows (bucket, pos, row): equal ranges of the concatenated buckets.

    One row for each memory-sized bucket enters the running sums, in groups of
    4,096 buckets and then over the groups, so no window task sees more.
    """
    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / 4096))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(across), F.lit(0)).alias("base"))
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select("bucket", (F.col("first") + F.col("base")).alias("first"))
    n = written.count()
    # shard s holds positions floor(s n / k) .. floor((s + 1) n / k) - 1: counts differ by one at most
    shard = F.expr(f"cast(((first + pos + 1) * {n_shards} - 1) div {max(n, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {n}) div {n_shards}")
    return written.join(firsts, "bucket").withColumn("shard", shard).withColumn("slot", F.col("first") + F.col("pos") - start).drop("bucket", "pos", "first")


def op1_external_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, Scratch(spark, "shards").path("data"))
    return shards.select(
        "doc_id", "size", F.crc32(text_or_empty()).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

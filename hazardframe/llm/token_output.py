"""Token files with keyed access by a minimal perfect hash index.

A file is a Parquet table of shards, written with Spark's own writer so that any
store that Spark reaches will do. A shard holds the raw little-endian ids of
consecutive documents in ascending key order, and its index: a minimal perfect
hash of the shard's distinct keys (levels of bit arrays with rank counts, each
level taking the keys that met no other there), a 32-bit fingerprint for each
key at its hash, and there the number of the key's first document. Looking a
key up costs a fixed number of bit tests and one fingerprint comparison, and
tells foreign keys apart but for one in 2**32.

`lookup` goes from keys to ids: the first and last keys of the shards, two
numbers each, say which shards to open; of those alone the index and the ids are
read. The list of all keys is a column of its own that only a full export reads.

A shard may end inside a key, so a key or null that many rows repeat fills
shards of the usual size over as many tasks as it needs; their order follows a
hash of the text.

Defined results: a null text has the end id alone. A key may repeat; a lookup
gives all its rows. A null key sorts first and is kept but not indexed. An empty
table gives no shards. The position of a shard's first id is the count of ids
before it in its writing task, which the shard holds, and in the tasks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted, slices, texts
from .tokens import encoder, tokenizer_path

#: Bytes of ids in a shard, and bits of a level for each key it is offered.
SHARD_BYTES = 512 << 10
GAMMA = 2
#: Keys of one look-up, which travel with its tasks.
LOOKUP_KEYS = 100_000
SHARD_DDL = (
    "shard_id long, before long, first_key long, last_key long, n_docs long, n_ids long, n_null_keys long, id_bytes int, "
    "keys binary, doc_starts binary, index_levels array<binary>, fingerprints binary, first_docs binary, ids binary"
)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit hash of integer keys."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct integer keys onto 0..n-1 with about 3.7 bits a key and no key stored."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.concatenate([[0], np.cumsum(bits)]))
            before += int(bits.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.int64)
        while len(left):
            at = mix(left, len(levels)) % np.uint64(GAMMA * len(left))
            met = np.bincount(at.astype(np.int64), minlength=GAMMA * len(left))
            levels.append(met == 1)
            left = left[met[at.astype(np.int64)] > 1]
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level takes it. A foreign key may get any number."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def from_bytes(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in levels])


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _shard(number: int, before: int, keys: list, ids: list[np.ndarray], id_bytes: int) -> dict:
    nulls = sum(k is None for k in keys)
    real = np.array(keys[nulls:], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8")
    distinct, first = np.unique(real, return_index=True)
    index = PerfectHash.build(distinct)
    slot = index.lookup(distinct)
    fingerprints, first_docs = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    fingerprints[slot], first_docs[slot] = _fingerprint(distinct), first + nulls
    return {
        "shard_id": number, "before": before, "first_key": keys[nulls] if nulls < len(keys) else None, "last_key": keys[-1], "n_docs": len(keys), "n_ids": int(starts[-1]), "n_null_keys": nulls, "id_bytes": id_bytes,
        "keys": real.astype("<i8").tobytes(), "doc_starts": starts.tobytes(), "index_levels": index.to_bytes(), "fingerprints": fingerprints.tobytes(), "first_docs": first_docs.tobytes(),
        "ids": np.concatenate(ids).astype(f"<u{id_bytes}").tobytes() if ids else b"",
    }


class Shard:
    """A shard read back: `find` for keyed access, `document` for the ids of one row."""

    def __init__(self, row: dict):
        self.row = row
        self.index = PerfectHash.from_bytes(row["index_levels"])
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        self.first_docs = np.frombuffer(row["first_docs"], "<u4")
        self.starts = np.frombuffer(row["doc_starts"], "<i8")
        self.ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's first document here, -1 for keys of other shards."""
        slot = self.index.lookup(keys)
        if not len(self.fingerprints):
            return np.full(len(keys), -1)
        ok = (slot >= 0) & (self.fingerprints[slot] == _fingerprint(keys))
        return np.where(ok, self.first_docs[slot].astype(np.int64), -1)

    def rows(self, first: np.ndarray) -> np.ndarray:
        """How many documents each key has here, from its first: up to the next key's first, or the end."""
        begins = np.append(np.sort(self.first_docs.astype(np.int64)), self.row["n_docs"])
        return begins[np.searchsorted(begins, first, side="right")] - first

    def document(self, doc: int) -> np.ndarray:
        return self.ids[self.starts[doc] : self.starts[doc + 1]]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes the documents in ascending key order and writes shards of about `shard_bytes` of ids under `path`.

    Texts are range-partitioned by key and hash and sorted within partitions
    (spilling if need be), so a task holds one shard at a time; shard numbers
    ascend with the partition and the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        width = 2 if enc.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        number, before = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in slices(batches, 256):
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                keys.append(key)
                ids.append(np.append(enc.ids(text), np.uint32(end_id)).astype(f"<u{width}"))
                held += width * len(ids[-1])
                if held >= shard_bytes:
                    yield _record(_shard(number, before, keys, ids, width))
                    number, before, keys, ids, held = number + 1, before + held // width, [], [], 0
        if keys:
            yield _record(_shard(number, before, keys, ids, width))

    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("key"), text.alias("text"), F.xxhash64(text).alias("h"))
    # rows that repeat key and text differ in their number, so they are dealt over tasks too
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    numbered.repartitionByRange("key", "h", "row").sortWithinPartitions("key", "h", "row").select("key", "text").mapInArrow(run, SHARD_DDL).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}[f.split()[1]]) for f in SHARD_DDL.split(", ")])


def _record(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def read_shards(spark, path: str) -> DataFrame:
    """The shards with start, the number of ids in all shards before them.

    One row for each task that wrote enters the running sum, and its result,
    two numbers for each such task, goes to the readers.
    """
    shards = spark.read.schema(SHARD_DDL).parquet(path)
    part = F.shiftright("shard_id", 32).alias("part")
    parts = shards.select(part, "n_ids").groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    met = shards.withColumn("part", part).join(F.broadcast(base), "part")
    return met.withColumn("start", F.col("base") + F.col("before")).drop("part", "base", "before")


def read_documents(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start, n_tokens, ids_crc32, found through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            shard = Shard(row)
            distinct, rows = np.unique(np.frombuffer(row["keys"], "<i8"), return_counts=True)
            first = shard.find(distinct)
            if (first < 0).any() or (shard.rows(first) != rows).any():
                raise ValueError(f"shard {row['shard_id']}: its index does not give its keys")
            numbers = [*range(row["n_null_keys"]), *np.concatenate([np.arange(f, f + n) for f, n in zip(first, rows, strict=True)] or [np.zeros(0, int)]).tolist()]
            keys = [None] * row["n_null_keys"] + np.repeat(distinct, rows).tolist()
            start = [row["start"] + int(shard.starts[d]) for d in numbers]
            length = [int(shard.starts[d + 1] - shard.starts[d]) for d in numbers]
            crc = [zlib.crc32(shard.document(d).astype("<u4").tobytes()) for d in numbers]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, start, length, crc)], [id_col, "start", "n_tokens", "ids_crc32"])

    return read_shards(spark, path).mapInArrow(run, f"{quoted(id_col)} long, start long, n_tokens long, ids_crc32 long")


def shards_of(spark, path: str, keys: np.ndarray) -> list[int]:
    """The shards whose range of keys holds any of `keys` (sorted); only the ranges are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            at = np.searchsorted(keys, first)
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= last)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["shard_id"])

    ranges = spark.read.schema(SHARD_DDL).parquet(path).where(F.col("first_key").isNotNull() & (F.col("first_key") <= int(keys[-1])) & (F.col("last_key") >= int(keys[0])))
    return [r[0] for r in ranges.select("shard_id", "first_key", "last_key").mapInArrow(run, "shard_id long").collect()]


def lookup(spark, path: str, keys: list[int]) -> DataFrame:
    """(key, shard_id, doc, ids) of every row of the keys, at most `LOOKUP_KEYS` of them; doc is its number in its shard.

    Keys that the files lack give no row.
    """
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"a look-up takes {LOOKUP_KEYS} keys at most")
    wanted = np.unique(np.array([k for k in keys if k is not None], np.int64))
    names = ["shard_id", "n_docs", "id_bytes", "doc_starts", "index_levels", "fingerprints", "first_docs", "first_key", "last_key", "ids"]
    shards = spark.read.schema(SHARD_DDL).parquet(path).select(*names)
    opened = shards.where(F.col("shard_id").isin(shards_of(spark, path, wanted) if len(wanted) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            shard = Shard(row)
            mine = wanted[np.searchsorted(wanted, row["first_key"]) : np.searchsorted(wanted, row["last_key"], side="right")]
            first = shard.find(mine)
            mine, first = mine[first >= 0], first[first >= 0]
            rows = shard.rows(first)
            key, doc = np.repeat(mine, rows), np.concatenate([np.arange(f, f + n) for f, n in zip(first, rows, strict=True)] or [np.zeros(0, int)])
            ids = pa.array([shard.document(d).astype(np.int64) for d in doc], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.full(len(key), row["shard_id"]), pa.int64()), pa.array(doc, pa.int64()), ids], ["key", "shard_id", "doc", "ids"])

    return opened.mapInArrow(run, "key long, shard_id long, doc long, ids array<long>")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("shards")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("word_bpe_49k.json"))
    return read_documents(spark, path)

"""Grace hash deduplication of whole texts.

Each input partition first folds its own copies in an open-addressing table of
bounded size, so a group that holds a third of all rows crosses the shuffle once
for each partition and not once for each row. One row for each distinct text of
a partition is then dealt by content hash. A task that gets more than its table
may hold writes the records to spill files by the next bits of the hash and
handles each file by itself, and so on. The table compares complete contents;
the hash only says where to look.

Defined results: a null text counts as empty, and empty texts are copies of each
other. Of equal texts the row with the largest doc_id stays; null ids lose to
any other. Rows that repeat doc_id and text are all marked kept in the report;
`exact_dedup` returns one of them. An empty table gives an empty result.
Columns of the input that carry a name of the report are replaced by it.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, all_of, hot_join, quoted, text_or_empty, tidy, utf8, without

REPORT = ["keep_id", "group_size", "kept", "text_sha256"]
#: Bytes of text that one table holds before it flushes (map side) or spills (reduce side).
TABLE_BYTES = 64 << 20
#: A level of the recursion looks at this many bits of the hash.
FAN_BITS = 4


class OpenTable:
    """Distinct contents with their largest id, rows, and rows that carry that id; linear probing."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = array("q", [-1]) * (self.mask + 1)
        self.entries: list[list] = []  # [hash, content, id, rows, rows with that id]
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """The slot where the content is or would go, and its entry or -1."""
        at = h & self.mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == h and entry[1] == content:
                return at, k
            at = (at + 1) & self.mask
        return at, -1

    def fold(self, k: int, key: int | None, rows: int, tied: int) -> None:
        entry = self.entries[k]
        entry[3] += rows
        if key == entry[2]:
            entry[4] += tied
        elif entry[2] is None or (key is not None and key > entry[2]):
            entry[2], entry[4] = key, tied

    def insert(self, at: int, record: list) -> None:
        self.slots[at] = len(self.entries)
        self.entries.append(record)
        self.bytes += len(record[1]) + 200
        if 2 * len(self.entries) > self.mask:
            self.mask = 4 * self.mask + 3
            self.slots = array("q", [-1]) * (self.mask + 1)
            for k, entry in enumerate(self.entries):
                at = entry[0] & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = k


def _spilled(path: str) -> Iterator[list]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(records: Iterable[list], limit: int, folder: str, level: int = 0) -> Iterator[list]:
    """The distinct contents of the records, each once, holding about `limit` bytes at a time.

    The files are scratch of this one task attempt: a lost executor costs the
    attempt, and the next one writes its own.
    """
    table, files = OpenTable(), None
    shift = 64 - FAN_BITS * (level + 1)
    paths = [f"{folder}/{level}-{i}-{os.urandom(4).hex()}" for i in range(1 << FAN_BITS)]
    try:
        for record in records:
            h = record[0]
            if files is None:
                at, k = table.find(h, record[1])
                if k >= 0:
                    table.fold(k, *record[2:])
                    continue
                if table.bytes + len(record[1]) <= limit or not table.entries or shift < 0:
                    table.insert(at, record)
                    continue
                files = [open(p, "wb", buffering=1 << 16) for p in paths]
                for kept in table.entries:
                    pickle.dump(kept, files[kept[0] >> shift & 15], protocol=5)
                table = OpenTable()
            pickle.dump(record, files[h >> shift & 15], protocol=5)
        if files is None:
            yield from table.entries
            return
        for f in files:
            f.close()
        for path in paths:
            yield from grace(_spilled(path), limit, folder, level + 1)
            os.unlink(path)
    finally:
        for f in files or ():
            f.close()


def _batch(entries: list[list], schema: pa.Schema, digest: bool) -> pa.RecordBatch:
    second = [hashlib.sha256(e[1]).hexdigest() for e in entries] if digest else [e[1].decode() for e in entries]
    first = [e[0] - (1 << 63) for e in entries]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((first, second, *([e[i] for e in entries] for i in (2, 3, 4))), schema.types, strict=True)], schema=schema)


_SCHEMA = pa.schema([("h", pa.int64()), ("content", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("tied", pa.int64())])
_DDL = "h long, content string, keep_id long, group_size long, tied long"


def _in_batches(entries: Iterable[list], digest: bool) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for e in entries:
        part.append(e)
        held += len(e[1])
        if held > 4 << 20 or len(part) >= 4096:
            yield _batch(part, _SCHEMA, digest)
            part, held = [], 0
    if part:
        yield _batch(part, _SCHEMA, digest)


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed() -> Iterator[list]:
        table = OpenTable()
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                h = xxhash.xxh3_64_intdigest(content)
                at, k = table.find(h, content)
                if k >= 0:
                    table.fold(k, key, 1, 1)
                    continue
                if table.bytes > TABLE_BYTES:
                    yield from table.entries
                    table = OpenTable()
                    at, _ = table.find(h, content)
                table.insert(at, [h, content, key, 1, 1])
        yield from table.entries

    return _in_batches(flushed(), False)


def _resolve_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[list]:
        for batch in batches:
            h, _, key, rows, tied = (c.to_pylist() for c in batch.columns)
            for x in zip(h, utf8(batch.column(1)), key, rows, tied, strict=True):
                yield [x[0] + (1 << 63), *x[1:]]

    with tempfile.TemporaryDirectory() as folder:
        yield from _in_batches(grace(records(), TABLE_BYTES, folder), True)


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id, group_size, tied (rows with keep_id)."""
    whole = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("content"))
    local = whole.mapInArrow(tidy(_fold_partition), _DDL)
    found = local.repartition("h").mapInArrow(tidy(_resolve_partition), _DDL)
    return found.select(F.col("content").alias("text_sha256"), "keep_id", "group_size", "tied")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with keep_id, group_size, kept and text_sha256.

    Each row gets its group by the digest of the whole text; rows of a very
    large group are dealt over many tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    groups = Scratch(docs.sparkSession, "groups").table(distinct_texts(docs, id_col, text_col).drop("tied"), "groups")
    return hot_join(rows, groups, ["text_sha256"], groups.select("text_sha256", F.col("group_size").alias("n"))).select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`.

    Rows that repeat text and id are dealt over many tasks, and each task folds its own before they meet.
    """
    key = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    groups = distinct_texts(docs, id_col, text_col).select(F.col("text_sha256").alias("__sha"), key("keep_id").alias("__key"), F.col("tied").alias("n"))
    groups = Scratch(docs.sparkSession, "kept").table(groups, "kept")
    rows = docs.withColumn("__sha", F.sha2(text_or_empty(text_col), 256)).withColumn("__key", key(id_col))
    return hot_join(rows, groups.drop("n"), ["__sha", "__key"], groups).dropDuplicates(["__sha", "__key"]).select(*all_of(docs))


def op10_grace_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_report(without(spark.read.parquet(f"{sf_dir}/documents.parquet"), REPORT))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

"""Vector code compression: a codebook for each part of the vectors, fitted by heap Lloyd.

Vectors become integers, are cut into equal consecutive parts, and each part gets
the number of its codebook's nearest entry. The first round measures every part
against every entry. It leaves with each chunk of vectors one heap for each entry
of each part: the members of the entry, keyed by how much farther the second
nearest entry is than the nearest (lower bound less upper bound) plus the drift
that the entry had gathered by then. When entries move, an entry's drift grows by
its own move and the largest move of any other; only members whose key is not
above the drift can have another nearest entry, so only they are popped, measured
again exactly, and put back. A heap lies in a row as its keys in ascending order,
which is a heap, and which lets numpy pop all violated members as one prefix.

A round reads the chunks that the last one wrote, writes their new state and the
changes of the entries' sums, one row a task; sums are added up by position, so
the driver sees the codebooks and nothing else. Sums are whole numbers and
distances too, so the result does not depend on how rows are dealt.

Defined results: rows whose vector is null or holds null or non-finite components
are dropped. Vectors that are shorter than the longest, and lengths that the
parts do not divide, are filled up with zeros at the end. Components whose
integer lies beyond 2**27 (for 64 components; less for more) count as that, so that
every distance fits 64 bits. The first entries are those of the smallest ids, null
ids last, equal ids by their vectors; with fewer vectors than entries the codebooks
are as short. Equal distances go to the lower index; an entry without members stays
as it is. Rows that repeat count as often. No vectors give no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, quoted, slices, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors, and components, of a chunk at most; members of a heap are 16-bit numbers.
CHUNK, CHUNK_SIZE = 4096, 1 << 22

STATE_DDL = "ids array<long>, labels array<string>, width int, vectors binary, members binary, keys binary, ends binary, changes array<long>"
_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("width", pa.int32()), *((n, pa.binary()) for n in ("vectors", "members", "keys", "ends")), ("changes", pa.list_(pa.int64()))])
_CODED = "id long, label string, code binary, error long"


@dataclass
class Codebooks:
    """Entries of all parts (parts, entries, components) and the drift that each has gathered."""

    entries: np.ndarray
    drift: np.ndarray
    sums: np.ndarray | None = None
    counts: np.ndarray | None = None

    def moved(self, changes: np.ndarray) -> Codebooks:
        """The next codebooks, after the changes of sums and counts of a round; Python's whole numbers throughout."""
        parts, n, width = self.entries.shape
        sums, counts = changes[: parts * n * width].reshape(parts, n, width), changes[parts * n * width :].reshape(parts, n)
        sums, counts = (sums, counts) if self.sums is None else (self.sums + sums, self.counts + counts)
        used = counts > 0
        entries = np.where(used[:, :, None], sums // np.where(used, counts, 1)[:, :, None], self.entries).astype(np.int64)
        move = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        other = np.zeros_like(move)
        for e in range(n if n > 1 else 0):
            other[:, e] = np.delete(move, e, axis=1).max(axis=1)
        return Codebooks(entries, self.drift + move + other, sums, counts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def measured(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, and how much farther the second nearest is."""
    squared = np.zeros((len(part), len(entries)), np.int64)
    for k in range(part.shape[1]):
        apart = part[:, k, None] - entries[None, :, k]
        squared += apart * apart
    rows, code = np.arange(len(part)), squared.argmin(axis=1)
    nearest = np.sqrt(squared[rows, code].astype(np.float64))
    squared[rows, code] = np.iinfo(np.int64).max
    return code, np.sqrt(squared.min(axis=1).astype(np.float64)) - nearest if len(entries) > 1 else np.full(len(part), np.inf)


class Chunk:
    """Vectors with the heaps of every part: the members by entry and key, their keys, and where each entry's heap ends."""

    def __init__(self, ids: list, labels: list, vectors: np.ndarray, members: np.ndarray, keys: np.ndarray, ends: np.ndarray):
        self.ids, self.labels, self.vectors, self.members, self.keys, self.ends = ids, labels, vectors, members, keys, ends

    @classmethod
    def first(cls, ids: list, labels: list, vectors: np.ndarray, books: Codebooks) -> Chunk:
        """Every part measured against every entry."""
        parts, n, width = books.entries.shape
        chunk = cls(ids, labels, vectors.reshape(-1, parts, width), *(np.zeros((parts, len(ids)), t) for t in (np.int64, np.float32)), np.zeros((parts, n), np.int64))
        for p in range(parts):
            code, slack = measured(chunk.vectors[:, p].astype(np.int64), books.entries[p])
            chunk._heap(p, np.arange(len(ids)), code, _key(slack + books.drift[p, code]))
        return chunk

    @classmethod
    def read(cls, row: dict, shape: tuple[int, int, int]) -> Chunk:
        (parts, n, width), rows = shape, len(row["ids"])
        arrays = (np.frombuffer(row[c], t).reshape(parts, -1) for c, t in (("members", "<u2"), ("keys", "<f4"), ("ends", "<i4")))
        return cls(row["ids"], row["labels"], np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(rows, parts, width), *(a.copy() for a in arrays))

    def row(self) -> dict:
        width = 2 if np.abs(self.vectors.astype(np.int64)).max(initial=0) < 1 << 15 else 4
        arrays = {"vectors": self.vectors.astype(f"<i{width}"), "members": self.members.astype("<u2"), "keys": self.keys.astype("<f4"), "ends": self.ends.astype("<i4")}
        return {"ids": self.ids, "labels": self.labels, "width": width} | {k: a.tobytes() for k, a in arrays.items()}

    def codes(self, p: int) -> np.ndarray:
        code = np.empty(len(self.ids), np.int64)
        code[self.members[p]] = np.repeat(np.arange(self.ends.shape[1]), np.diff(self.ends[p], prepend=0))
        return code

    def _heap(self, p: int, members: np.ndarray, code: np.ndarray, keys: np.ndarray) -> None:
        order = np.lexsort((keys, code))
        self.members[p], self.keys[p] = members[order], keys[order]
        self.ends[p] = np.searchsorted(code[order], np.arange(self.ends.shape[1]), side="right")

    def settle(self, books: Codebooks, changes: np.ndarray | None = None) -> int:
        """Pops the members whose key the drift has reached, measures them again and puts them back; how many there were.

        changes: sums and counts of the entries as one row, to which what members that go elsewhere change is added.
        """
        parts, n, width = books.entries.shape
        popped = 0
        for p in range(parts):
            begins = np.concatenate([[0], self.ends[p][:-1]]).astype(np.int64)
            reach = books.drift[p] * (1 + 1e-6) + 1e-6
            taken = np.zeros(len(self.ids), bool)
            for e in np.flatnonzero(books.drift[p] > 0):
                taken[begins[e] : begins[e] + np.searchsorted(self.keys[p, begins[e] : self.ends[p, e]], reach[e], side="right")] = True
            if not taken.any():
                continue
            popped += int(taken.sum())
            code = np.repeat(np.arange(n), np.diff(self.ends[p], prepend=0))
            members, before = self.members[p, taken], code[taken]
            rows = self.vectors[members, p].astype(np.int64)
            after, slack = measured(rows, books.entries[p])
            if changes is not None and (go := after != before).any():
                add_up(changes, books.entries.shape, p, before[go], rows[go], -1)
                add_up(changes, books.entries.shape, p, after[go], rows[go], 1)
            keys = np.append(self.keys[p, ~taken], _key(slack + books.drift[p, after]))
            self._heap(p, np.append(self.members[p, ~taken], members), np.append(code[~taken], after), keys)
        return popped


def _key(values: np.ndarray) -> np.ndarray:
    """The next 32-bit number below, so that rounding never hides a violated bound."""
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


def add_up(changes: np.ndarray, shape: tuple[int, int, int], p: int, code: np.ndarray, rows: np.ndarray, sign: int) -> None:
    parts, n, width = shape
    sums, counts = changes[: parts * n * width].reshape(shape), changes[parts * n * width :].reshape(parts, n)
    np.add.at(sums[p], code, sign * rows)
    np.add.at(counts[p], code, sign)


def _record(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=_STATE)


def whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, filled up with zeros to `dim` and kept within what distances allow."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out, most = np.zeros((len(column), dim), np.int64), math.isqrt((1 << 62) // dim) // 2
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.clip(values, -most, most).astype(np.int64)
    return out


def _changes(shape: tuple[int, int, int]) -> np.ndarray:
    parts, n, width = shape
    return np.zeros(parts * n * width + parts * n, np.int64)


def _first_round(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int) -> Iterator[pa.RecordBatch]:
    shape = books.entries.shape
    dim, changes = shape[0] * shape[2], _changes(shape)
    for batch in slices(batches, max(1, min(CHUNK, CHUNK_SIZE // dim))):
        if batch.num_rows:
            chunk = Chunk.first(batch.column(0).to_pylist(), batch.column(1).to_pylist(), whole_numbers(batch.column(2), dim, scale), books)
            for p in range(shape[0]):
                add_up(changes, shape, p, chunk.codes(p), chunk.vectors[:, p], 1)
            yield _record(chunk.row())
    yield _record({"changes": changes.tolist()})


def _next_round(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    changes = _changes(books.entries.shape)
    for batch in slices(batches, 1):
        chunk = Chunk.read(batch.to_pylist()[0], books.entries.shape)
        chunk.settle(books, changes)
        yield _record(chunk.row())
    yield _record({"changes": changes.tolist()})


def _last_round(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    parts = books.entries.shape[0]
    for batch in slices(batches, 1):
        chunk = Chunk.read(batch.to_pylist()[0], books.entries.shape)
        chunk.settle(books)
        codes, error = np.zeros((len(chunk.ids), parts), np.uint8), np.zeros(len(chunk.ids), np.int64)
        for p in range(parts):
            code = chunk.codes(p)
            codes[:, p] = code
            error += ((chunk.vectors[:, p].astype(np.int64) - books.entries[p][code]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(chunk.labels, pa.string()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["id", "label", "code", "error"])


def _summed(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The changes of a round by position: as many numbers as the codebooks have, and a count for each entry."""
    total = np.array([0] * len(_changes(shape)), object)
    found = state.where("changes is not null").select(F.posexplode("changes").alias("at", "x")).where("x != 0")
    for row in found.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        total[row["at"]] = int(row["x"])
    return total


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error) of every usable vector, written, with the codebooks; None for these where there is no vector."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is a byte")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    v = F.col(quoted(vector_col)).cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(label_col)).cast("string").alias("label"), v.alias("v")).where(usable)
    longest = rows.agg(F.max(F.size("v"))).head()[0]
    if longest is None:
        return spark.createDataFrame([], _CODED), None
    dim = parts * max(1, math.ceil(longest / parts))
    start = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = whole_numbers(pa.array([r["v"] for r in start], pa.list_(pa.float64())), dim, scale)
    first = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    books = Codebooks(first, np.zeros(first.shape[:2]))
    given = books
    state = scratch.table(rows.mapInArrow(tidy(lambda it: _first_round(it, given, scale)), STATE_DDL), "round-0")
    for k in range(1, rounds + 1):
        books = books.moved(_summed(state, first.shape))
        chunks, given = state.where("ids is not null"), Codebooks(books.entries, books.drift)
        if k == rounds:
            break
        state = scratch.table(chunks.mapInArrow(tidy(lambda it, b=given: _next_round(it, b)), STATE_DDL), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
    coded = scratch.table(state.where("ids is not null").mapInArrow(tidy(lambda it: _last_round(it, given)), _CODED), "coded")
    scratch.drop(f"round-{max(rounds, 1) - 1}")
    return coded, books


def op12_heap_lloyd(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = coded.groupBy("__label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"))
    sums = Scratch(spark, "labels").table(sums, "sums")
    met = hot_join(coded, sums.drop("n"), ["__label"], sums.select("__label", "n"))
    return met.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    apart = "list_sum(list_transform(range(1, len(t.part) + 1), lambda i: (t.part[i] - b.part[i]) * (t.part[i] - b.part[i])))"
    return f"SELECT r, vec_id, label, p, any_value(t.part) AS part, min({apart} * {ENTRIES} + e)::BIGINT AS m FROM t JOIN {book} b USING (p) GROUP BY r, vec_id, label, p"


def _updated(assigned: str, book: str) -> str:
    return f"""SELECT b.p, b.e, CASE WHEN any_value(s.part) IS NULL THEN b.part ELSE any_value(s.part) END AS part FROM {book} b LEFT JOIN (
      SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS part FROM (
        SELECT p, m % {ENTRIES} AS e, i, sum(part[i])::BIGINT AS s, count(*) AS n FROM {assigned}, range(1, (SELECT max(len(part)) FROM t) + 1) AS u(i) GROUP BY ALL) GROUP BY p, e) s
      ON b.p = s.p AND b.e = s.e GROUP BY b.p, b.e, b.part"""


OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT r, vec_id, label, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS part FROM v, range({PARTS}) AS u(p)),
b0 AS (SELECT p, r - 1 AS e, part FROM t WHERE r <= {ENTRIES}),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_updated("a0", "b0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_updated("a1", "b1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
c AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
k AS (SELECT r, vec_id, label, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a2 GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k, c
"""

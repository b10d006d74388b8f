"""Lines that many documents share: range-partitioned hashes, a stream over each partition, keep bitmaps.

A first pass reads the texts and writes, for each line whose key is long enough,
its 128-bit hash with the document and the line's position; no text. These rows
are range-partitioned by hash and document and sorted within partitions by hash,
document (largest first) and position, so the first document of a hash is the
one that keeps its lines, and a very common line is cut over as many partitions
as its rows need. A task streams its rows: runs that lie inside the partition
are decided there; of the first and the last run, which may go on in another
partition, it returns the number of documents and the largest one, at most two
rows a task, and the rows that this leaves open. What is dropped is gathered by
document into a compressed bitmap, which `apply_bitmaps` lays over the texts.

A document is a distinct pair of id and text: rows that repeat both count once and
get one bitmap; rows that share only the id are documents of their own.

Defined results: a null text counts as empty, one empty line. Null ids lose to
any other; if all holders of a key have null ids, all keep it, as do all holders
of the largest id. A document whose lines all go keeps an empty text. Tables may be
empty. Extra columns pass `dedup_lines` whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, all_of, hot_join, quoted, slices, text_or_empty, tidy, utf8

#: Code points of a key, and documents that hold it, from which its lines are dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Documents of one partition whose repeats are found before the shuffle.
REMEMBERED = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The key of a line, or None where it has fewer than `least` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return key


def _hashed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc, mark, pos, times) of each long line; a document that repeats in the partition gives a row (.., times) with its further rows instead."""
    seen: dict = {}

    def repeats() -> pa.RecordBatch:
        again = [(doc, mark, n) for (doc, mark), n in seen.items() if n]
        none = pa.nulls(len(again), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([x[0] for x in again], pa.int64()), pa.array([x[1] for x in again], pa.int64()), none, pa.array([x[2] for x in again], pa.int64())], _LINES)

    for batch in slices(batches):
        ids, marks, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for doc, mark, text in zip(ids, marks, utf8(batch.column(2)), strict=True):
            if (doc, mark) in seen:
                seen[doc, mark] += 1
                continue
            seen[doc, mark] = 0
            if len(text) < least:
                continue
            for pos, line in enumerate(text.split(b"\n")):
                if len(line) >= least and (key := line_key(line, least)):
                    out.append((*np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").tolist(), doc, mark, pos, 0))
            if len(out) > 1 << 16:
                yield _rows(out, _LINES)
                out = []
        if out:
            yield _rows(out, _LINES)
        if len(seen) > REMEMBERED:
            yield repeats()
            seen.clear()
    yield repeats()


_LINES = ["h1", "h2", "doc", "mark", "pos", "times"]
_STREAMED = ["kind", "h1", "h2", "doc", "mark", "value"]
#: Kinds of streamed rows: a line to drop, a line whose key is open, and a run of an open key (doc: the largest; value: documents).
DROP, OPEN, RUN = 0, 1, 2


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)


class _Run:
    """A hash whose rows may go on in the next batch or partition."""

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first = key, first
        self.docs, self.top, self.last, self.pos = 0, None, None, None
        self.waiting: list[tuple] = []  # lines of the first few documents, which all get one answer

    def take(self, docs: list, marks: list, positions: list, least: int) -> list[tuple]:
        """Takes sorted rows; returns what is decided."""
        out = []
        for doc, mark, pos in zip(docs, marks, positions, strict=True):
            if (doc, mark) != self.last:
                self.top = doc if not self.docs else self.top
                self.docs, self.last, self.pos = self.docs + 1, (doc, mark), None
            if pos == self.pos:  # the same row again
                continue
            self.pos = pos
            if self.first:
                out.append((OPEN, *self.key, doc, mark, pos))
            elif doc != self.top:
                self.waiting.append((doc, mark, pos))
        if self.docs >= least and self.waiting:
            out += [(DROP, *self.key, *x) for x in self.waiting]
            self.waiting = []
        return out

    def end(self, last: bool) -> list[tuple]:
        if not (self.first or last):
            return []
        return [(OPEN, *self.key, *x) for x in self.waiting] + [(RUN, *self.key, self.top, None, self.docs)]


def _streamed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Decides the runs of a sorted partition. Runs inside one batch are decided together, the first and last run of each row by row."""
    run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, pos = (batch.column(k).to_numpy() for k in (0, 1, 4))
        doc, mark = batch.column(2).fill_null(0).to_numpy(), batch.column(3).to_numpy()
        null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(2).to_pylist()
        changed = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        borders = np.append(np.flatnonzero(changed), batch.num_rows)
        out: list[tuple] = []

        def take(a: int, b: int, held: _Run, ids: list = ids, mark: np.ndarray = mark, pos: np.ndarray = pos) -> list[tuple]:
            return held.take(ids[a:b], mark[a:b].tolist(), pos[a:b].tolist(), least)

        key = (int(h1[0]), int(h2[0]))
        if run is None or run.key != key:
            out += run.end(False) if run else []
            run = _Run(key, run is None)
        out += take(0, borders[1], run)
        if len(borders) > 2:
            out += run.end(False)
            a, b = int(borders[1]), int(borders[-2])
            if b > a:
                starts = borders[1:-2] - a
                fresh = changed[a:b] | (doc[a:b] != doc[a - 1 : b - 1]) | (null[a:b] != null[a - 1 : b - 1]) | (mark[a:b] != mark[a - 1 : b - 1])
                number = np.cumsum(changed[a:b]) - 1
                docs = np.add.reduceat(fresh.astype(np.int64), starts)
                other = (doc[a:b] != doc[a:b][starts][number]) | (null[a:b] != null[a:b][starts][number])
                again = ~fresh & (pos[a:b] == pos[a - 1 : b - 1])
                drop = a + np.flatnonzero((docs >= least)[number] & other & ~again)
                out += [(DROP, int(h1[k]), int(h2[k]), ids[k], int(mark[k]), int(pos[k])) for k in drop]
            run = _Run((int(h1[b]), int(h2[b])), False)
            out += take(b, batch.num_rows, run)
        if out:
            yield _rows(out, _STREAMED)
    if run:
        yield _rows(run.end(True), _STREAMED)


def _bitmap(positions: list[int]) -> bytes:
    """Bits of the lines up to the last dropped one, 1 where a line stays; compressed."""
    keep = np.ones(max(positions) + 1, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes() + bytes([-len(keep) % 8]))


def kept_lines(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of a document's lines stay; lines beyond the bitmap do."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        packed = zlib.decompress(bitmap)
        bits = np.unpackbits(np.frombuffer(packed[:-1], np.uint8), bitorder="little")
        bits = bits[: len(bits) - packed[-1]]
        keep[: len(bits)] = bits == 1
    return keep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        dropped = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in dropped], pa.int64()), pa.array([_bitmap(x) for x in dropped], pa.binary())], ["doc", "mark", "n_dropped", "bitmap"])


def _marked(docs: DataFrame, id_col: str, text_col: str) -> list:
    text = text_or_empty(text_col)
    return [F.col(quoted(id_col)).cast("long"), F.xxhash64(text), text]


def keep_bitmaps(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(doc, mark, n_dropped, bitmap) of each document that loses lines, and (doc, mark, n) of documents in several rows.

    mark is the xxhash64 of the text; both tables are written under `scratch`.
    """
    doc, mark, text = _marked(docs, id_col, text_col)
    types = ", ".join(f"{c} long" for c in _LINES)
    lines = docs.select(doc.alias("doc"), mark.alias("mark"), text.alias("text")).mapInArrow(tidy(lambda it: _hashed(it, least_chars)), types)
    lines = scratch.table(lines, "lines")
    repeats = scratch.table(lines.where("h1 is null").groupBy("doc", "mark").agg((F.sum("times") + F.count("*")).alias("n")), "repeats")
    by = ["h1", "h2", F.col("doc").desc_nulls_last(), "mark"]
    dealt = lines.where("h1 is not null").drop("times").repartitionByRange(*by).sortWithinPartitions(*by, "pos")
    types = ", ".join(f"{c} long" for c in _STREAMED)
    streamed = scratch.table(dealt.mapInArrow(tidy(lambda it: _streamed(it, least_docs)), types), "streamed")
    scratch.drop("lines")
    # two rows a task at most, one for each key
    runs = streamed.where(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.sum("value").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= least_docs)
    is_open = streamed.where(F.col("kind") == OPEN).join(F.broadcast(runs), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("top")))
    dropped = streamed.where(F.col("kind") == DROP).select("doc", "mark", "value").union(is_open.select("doc", "mark", "value"))
    gathered = dropped.groupBy("doc", "mark").agg(F.collect_set("value").alias("dropped"))
    return scratch.table(gathered.mapInArrow(tidy(_bitmaps), "doc long, mark long, n_dropped long, bitmap binary"), "bitmaps"), repeats


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with __dropped and __bitmap, null where a document keeps all lines; rows of one much repeated document are dealt over many tasks.

    Texts are shuffled once to meet their bitmaps, at every size.
    """
    doc, mark, _ = _marked(docs, id_col, text_col)
    name = F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("__doc")  # a null id has a name of its own
    rows = docs.withColumn("__doc", F.coalesce(doc.cast("string"), F.lit(""))).withColumn("__mark", mark)
    maps = bitmaps.select(name, F.col("mark").alias("__mark"), F.col("n_dropped").alias("__dropped"), F.col("bitmap").alias("__bitmap"))
    return hot_join(rows, maps, ["__doc", "__mark"], repeats.select(name, F.col("mark").alias("__mark"), "n"), "left", "merge").drop("__doc", "__mark")


def _left(text: bytes, bitmap: bytes | None) -> bytes:
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    keep = kept_lines(bitmap, len(lines))
    return b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """`docs` with the texts that are left; a null text becomes empty."""

    @F.pandas_udf("string")
    def left(text, bitmap):  # noqa: ANN001, ANN202
        return text.combine(bitmap, lambda t, b: _left(t.encode(), b).decode())

    maps = keep_bitmaps(docs, Scratch(docs.sparkSession, "lines"), id_col, text_col, least_chars, least_docs)
    met = apply_bitmaps(docs, *maps, id_col, text_col)
    return met.withColumn(text_col, F.when(F.col("__bitmap").isNull(), text_or_empty(text_col)).otherwise(left(text_or_empty(text_col), "__bitmap"))).select(*all_of(docs))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        whole = utf8(batch.column(1))
        lines = pa.array([t.count(b"\n") + 1 for t in whole], pa.int64())
        kept = pa.array([hashlib.sha256(_left(t, b)).hexdigest() for t, b in zip(whole, batch.column(3).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), lines, batch.column(2), kept], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op13_line_bitmaps(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    met = apply_bitmaps(docs, *keep_bitmaps(docs, Scratch(spark, "lines")))
    rows = met.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(), F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"), "__bitmap")
    return rows.mapInArrow(tidy(_digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT r, k.doc_id, line, pos, g.key IS NOT NULL AND k.doc_id <> g.top AS dropped FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

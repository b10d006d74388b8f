"""Ranked lexical search over a stored index of document shards, by variable-block-max WAND.

A shard is a bounded run of documents of one input partition, so building moves
no postings: each task writes its shards, one row each, with the impact of every
posting (what it adds to a score for each unit of its term's weight). A dynamic
program cuts each posting list into blocks of varying length so that the sum of
(block maximum - impact) plus a price for each block is least. A search adds up
the block maxima of its terms over a shard's documents; the pivots are the
documents whose sum reaches the worst of the k scores held so far. Pivots are
taken in runs of `STEP`, only blocks that hold one are opened, their postings are
added up exactly, and what that run found moves the threshold for the next one.
The k best of a task go on from shard to shard; the k best of all tasks are
merged in two rounds. The result is exact.

Defined results: a null or empty text holds no term and is no document of N; a
row is a document, so rows that repeat count and are ranked as often. Equal
scores are ordered by ascending id, null ids last. Queries that are equal in id
and text are one; rows that share only the id are answered each by itself. A
query without terms, or none of whose terms occur, gives no rows; so does an
empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, quoted, slices, text_or_empty, tidy, utf8

#: A shard ends at this many documents (local numbers fit 16 bits) or bytes of text.
SHARD_DOCS, SHARD_BYTES = 4096, 8 << 20
#: Price of a block in units of impact, and the most postings in one.
BLOCK_PRICE, BLOCK_MOST = 1_000_000, 64
#: Pivots scored at a time.
STEP = 256
#: Queries, and bytes of their texts, that go with the tasks of one pass over the index.
QUERIES_AT_ONCE, QUERY_BYTES = 1024, 8 << 20
#: Groups in which the results of tasks are merged first.
MERGES = 64

#: Letters, digits and all bytes beyond ASCII stay, A-Z in lower case; the rest separates terms.
_TERMS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))

INDEX_DDL = "doc_ids array<long>, n_terms long, terms array<string>, list_ends binary, docs binary, impacts binary, list_blocks binary, block_ends binary, block_most binary"
_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_terms", pa.int64()), ("terms", pa.list_(pa.string())), *((n, pa.binary()) for n in ("list_ends", "docs", "impacts", "list_blocks", "block_ends", "block_most"))])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in slices(batches):
        for text in utf8(batch.column(0)):
            n = len(terms_of(text))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(N, L): documents with a term, and all their terms."""
    row = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).head()
    return row[0] or 0, row[1] or 0


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight, rounded down."""
    if 75 * int(n.max(initial=0)) * docs >= 1 << 63:  # the product needs more than 64 bits, the quotient does not
        m = np.array([25 + 75 * x * docs // terms for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n * docs // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def cut_blocks(impacts: np.ndarray, ends: np.ndarray, price: int = BLOCK_PRICE, most: int = BLOCK_MOST) -> tuple[np.ndarray, np.ndarray]:
    """(block ends, blocks up to and with each list) of least bound error plus `price` a block, with at most `most` postings each.

    The best cut of the first j + 1 postings ends with a block from some start
    s: best[s] + (j + 1 - s) * maximum + price. All lists take step j together; a
    window of columns holds the last `most` starts, start s in column s % most.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    begin, ascending = starts[order], np.sort(lengths)
    length_of_last = np.zeros(len(impacts), np.int64)
    width = int(min(most, lengths.max(initial=0)))
    top, before = np.zeros((len(ends), width), np.int64), np.zeros((len(ends), width), np.int64)
    for j in range(int(lengths.max(initial=0))):
        n, live, new = len(ends) - int(np.searchsorted(ascending, j, side="right")), min(j + 1, width), j % width
        x = impacts[begin[:n] + j]
        np.maximum(top[:n, :live], x[:, None], out=top[:n, :live])
        top[:n, new] = x
        size = (new - np.arange(live)) % width + 1
        cost = before[:n, :live] + top[:n, :live] * size
        pick = cost.argmin(axis=1)
        length_of_last[begin[:n] + j] = size[pick]
        if j + 1 < lengths.max():
            before[:n, (j + 1) % width] = cost[np.arange(n), pick] + price
    is_end = np.zeros(len(impacts) + 1, bool)
    at = ends.astype(np.int64)
    while len(at):
        is_end[at] = True
        at = at - length_of_last[at - 1]
        at = at[~_member(starts, at)]
    block_ends = np.flatnonzero(is_end)
    return block_ends.astype(np.int32), np.searchsorted(block_ends, ends, side="right").astype(np.int32)


def _member(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def _shard(ids: list, texts: list[bytes], docs: int, terms: int) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    split = pc.ascii_split_whitespace(pa.array([texts[k] for k in order], pa.large_binary()).cast(pa.large_string()))
    n = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), n))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf, key = np.diff(np.append(first, len(key))), key[first]
    term, doc = key // len(ids), key % len(ids)
    impacts = impact(tf, n[doc], docs, terms)
    list_ends = np.searchsorted(term, np.arange(len(coded.dictionary)), side="right")
    block_ends, list_blocks = cut_blocks(impacts, list_ends)
    block_most = np.maximum.reduceat(impacts, np.concatenate([[0], block_ends[:-1]]))
    row = {"doc_ids": [ids[k] for k in order], "n_terms": int(n.sum()), "terms": coded.dictionary.cast(pa.string()).to_pylist()}
    arrays = {"list_ends": list_ends, "docs": doc, "impacts": impacts, "list_blocks": list_blocks, "block_ends": block_ends, "block_most": block_most}
    return pa.RecordBatch.from_pylist([row | {k: a.astype("<u2" if k == "docs" else "<i4").tobytes() for k, a in arrays.items()}], schema=_INDEX)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of `docs`, a row for each shard, as Parquet under `path`."""
    n_docs, n_terms = corpus_size(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                text = text.translate(_TERMS).strip()
                if not text:
                    continue
                if ids and (len(ids) >= SHARD_DOCS or held + len(text) > SHARD_BYTES):
                    yield _shard(ids, texts, n_docs, n_terms)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(text)
                held += len(text)
        if ids:
            yield _shard(ids, texts, n_docs, n_terms)

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows.mapInArrow(tidy(run), INDEX_DDL).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


class Best:
    """The k best (score, id) of one query so far; ids by rank, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """The least score that may still enter: an equal one with a smaller id does."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.null, null)
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all half-open spans, one after the other."""
    n = last - first
    return np.arange(int(n.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.terms = row["terms"]
        self.ids = np.array([0 if x is None else x for x in row["doc_ids"]], np.int64)
        self.null = np.array([x is None for x in row["doc_ids"]], bool)
        self.docs = np.frombuffer(row["docs"], "<u2")
        self.impacts, self.block_ends, self.block_most, self.list_blocks = (np.frombuffer(row[c], "<i4") for c in ("impacts", "block_ends", "block_most", "list_blocks"))
        self.block_starts = np.concatenate([[0], self.block_ends[:-1]])
        self.block_low, self.block_high = self.docs[self.block_starts], self.docs[self.block_ends - 1].astype(np.int64) + 1
        self.opened = 0  # postings read, for tests

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds this shard's documents that belong to the best; `terms` are list numbers, `weights` theirs times their number in the query."""
        last = self.list_blocks[terms].astype(np.int64)
        first = np.where(terms > 0, self.list_blocks[terms - 1], 0)
        blocks, weight = _spans(first, last), np.repeat(weights, last - first)
        low, high, size = self.block_low[blocks], self.block_high[blocks], len(self.ids) + 1
        most = np.zeros(size, np.int64)
        np.add.at(most, low, weight * self.block_most[blocks])
        np.subtract.at(most, high, weight * self.block_most[blocks])
        bound = np.cumsum(most)[:-1]
        if len(best.scores) < best.k and len(bound) > STEP:  # the most promising documents first give a threshold
            run = np.sort(np.argpartition(-bound, STEP)[:STEP])
            self._score(run, blocks, weight, low, high, best)
            bound[run] = 0
        at = 0
        while True:
            pivots = at + np.flatnonzero(bound[at:] >= best.threshold)[:STEP]
            if not len(pivots):
                return
            self._score(pivots, blocks, weight, low, high, best)
            at = int(pivots[-1]) + 1

    def _score(self, run: np.ndarray, blocks: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> None:
        number = np.full(len(self.ids), -1)
        number[run] = np.arange(len(run))
        upto = np.concatenate([[0], np.cumsum(number >= 0)])
        hold = upto[high] > upto[low]
        first, last = self.block_starts[blocks[hold]].astype(np.int64), self.block_ends[blocks[hold]].astype(np.int64)
        at, times = _spans(first, last), np.repeat(weight[hold], last - first)
        self.opened += len(at)
        to = number[self.docs[at]]
        mine = to >= 0
        scores = np.zeros(len(run), np.int64)
        np.add.at(scores, to[mine], times[mine] * self.impacts[at[mine]])
        enter = scores >= best.threshold
        best.add(scores[enter], self.ids[run[enter]], self.null[run[enter]])


def _frequencies(index: DataFrame, terms: list[str]) -> np.ndarray:
    """How many documents hold each of the terms."""
    wanted = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in slices(batches, 1):
            at = pc.index_in(wanted, value_set=batch.column(0).flatten()).to_numpy(zero_copy_only=False)
            here, n = np.flatnonzero(at == at), np.diff(np.frombuffer(batch.column(1)[0].as_py(), "<i4"), prepend=0)
            df[here] += n[at[here].astype(np.int64)]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    found = np.zeros(len(terms), np.int64)
    for row in index.select("terms", "list_ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[row["term"]] = row["df"]
    return found


def _answers(index: DataFrame, queries: list[tuple[object, bytes]], n_docs: int, k: int) -> DataFrame:
    """(query, id, score): the k best of each task for each of the queries."""
    counts = [Counter(t.decode() for t in terms_of(text)) for _, text in queries]
    terms = sorted(set().union(*counts))
    number = {t: j for j, t in enumerate(terms)}
    df = _frequencies(index, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    asked = []
    for q, held in enumerate(counts):
        own = np.array([number[t] for t in held], np.int64)
        times = np.array(list(held.values()), np.int64)
        used = (df[own] > 0) & (weight[own] > 0) if len(own) else np.zeros(0, bool)
        if used.any():
            asked.append((q, own[used], (times * weight[own])[used]))
    wanted = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked]
        for batch in slices(batches, 1):
            shard = Shard(batch.to_pylist()[0])
            at = pc.index_in(wanted, value_set=pa.array(shard.terms, pa.string())).fill_null(-1).to_numpy()
            for (_, own, weights), held in zip(asked, best, strict=True):
                mine = at[own]
                if (mine >= 0).any():
                    shard.search(mine[mine >= 0], weights[mine >= 0], held)
        for (q, _, _), held in zip(asked, best, strict=True):
            if len(held.scores):
                ids = pa.array(held.ids, pa.int64(), mask=held.null)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int64()), ids, pa.array(held.scores, pa.int64())], ["query", "id", "score"])

    return index.mapInArrow(tidy(run), "query long, id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each query's k best documents: its id, rank, the document's id, score. `index` is what `build_index` wrote.

    Queries go with the tasks in passes of `QUERIES_AT_ONCE` or `QUERY_BYTES`, whichever is less.
    """
    spark, scratch = index.sparkSession, Scratch(index.sparkSession, "search")
    n_docs = index.agg(F.sum(F.size("doc_ids"))).head()[0] or 0
    asked = queries.select(F.col(quoted(query_id)).alias("item"), text_or_empty(query_text).alias("text")).distinct()
    asked = scratch.table(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("m")).head()
    passes = max(1, math.ceil(size["n"] / QUERIES_AT_ONCE), math.ceil((size["m"] or 0) / QUERY_BYTES))
    found = None
    for p in range(passes if n_docs else 0):
        mine = asked.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == p).collect()
        part = scratch.table(_answers(index, [(r["number"], r["text"].encode()) for r in mine], n_docs, k), f"answers-{p}")
        names = spark.createDataFrame([(q, r["number"]) for q, r in enumerate(mine)], "query long, number long")
        part = part.join(F.broadcast(names), "query").drop("query")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "id long, score long, number long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for by in ([F.col("number"), F.pmod(F.xxhash64("id"), F.lit(MERGES))], [F.col("number")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(asked, "number").select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def op11_block_max_search(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "index").path("shards")
    build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return search(spark.read.schema(INDEX_DDL).parquet(path), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, {_SPLIT} AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n_docs),
m AS (SELECT r, 25 + (75 * n * n_docs) // n_terms AS m FROM n, c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_SPLIT} AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""

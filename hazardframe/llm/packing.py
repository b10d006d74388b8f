"""Mixture-controlled packing of token streams into fixed windows.

Each source is a queue: the concatenated ids of its documents. A queue earns
its share of every window; it hands over the whole tokens it has earned and
carries the fraction, its deficit, to the next window. Tokens still free after a
round go to the queues with the largest deficits. When a queue runs dry, those
left share its part in their proportions, so no token is ever left out.

Shares are the `targets` asked for; sources that they do not name are one more
queue, which has the share left over or, if there is none, fills the windows
after all others. Without targets the shares are the corpus's own, of its
`QUEUES` largest sources and of the others together, so all queues drain at
once. What a driver or a task holds thus depends on the queues, not on the
number of sources.

Windows are independent across segments of `SEGMENT` windows. What a queue has
handed over before a segment is known in closed form (the point up to which the
shares of all queues add up to the segment's first token), so each segment
starts with the deficits that the one before it ends with and segments run in
parallel. A hot source is cut by segments like any other: no task holds a whole
queue.

Defined results: a null text is empty and gives its end id alone. A null source
is a queue of its own. Repeated rows are packed as often as they occur. Pieces
name their row by `row_id` too, as ids may repeat. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted, slices, text_or_empty, texts, tidy
from .tokens import encoder, tokenizer_path

WINDOW = 2048
#: Windows of a segment, the unit of parallel work: about a million ids.
SEGMENT = 512
#: Sources that have a queue of their own when no targets are given.
QUEUES = 4096
#: Scale of shares in whole numbers, and of due times.
SHARE, ONE = 10**9, 1 << 128
#: Rows (queue, input partition, position) up to which they are broadcast; beyond it their join shuffles.
BROADCAST_ROWS = 50_000


def _source_key(docs: DataFrame, source_col: str | None):
    return F.coalesce(F.concat(F.lit("="), F.col(quoted(source_col)).cast("string")), F.lit("null")) if source_col else F.lit("=all")


def queue_numbers(docs: DataFrame, source_col: str | None, text_col: str, targets: dict | None, queues: int = QUEUES) -> dict[str, int]:
    """The number of each source that has its own queue; all others are the next one together."""
    if targets is not None:
        names = [f"={s}" if s is not None else "null" for s in targets]
    else:
        sizes = docs.groupBy(_source_key(docs, source_col).alias("source")).agg(F.sum(F.octet_length(text_or_empty(text_col)) + 1).alias("m"))
        names = [r["source"] for r in sizes.orderBy(F.desc("m"), "source").limit(queues).collect()]
    return {s: k for k, s in enumerate(sorted(names))}


def shares(number: dict[str, int], targets: dict | None, totals: list[int]) -> list[int]:
    """Whole-number weights of the queues: of the targets, or the corpus's own sizes."""
    if targets is None:
        return list(totals)
    wanted = {f"={s}" if s is not None else "null": x for s, x in targets.items()}
    if min(wanted.values(), default=0) < 0 or sum(wanted.values()) > 1 + 1e-9:
        raise ValueError("targets are shares of 0 or more that add up to 1 at most")
    weights = [round(wanted[s] * SHARE) for s in sorted(number, key=number.get)]
    return [*weights, max(0, SHARE - sum(weights))]


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch, id_col: str, text_col: str, source_col: str | None, number: dict[str, int]) -> DataFrame:
    """Written table: row_id, doc_id, queue, n, ids, part (input partition) and at (ids before it of its queue in its part).

    The position inside a part is counted while encoding; because the table is
    written, it cannot change when a later task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, counted, row = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (len(number) + 1), 0
        for batch in slices(batches, 1024):
            queue = [number.get(s, len(number)) for s in batch.column(1).to_pylist()]
            ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in enc.many(texts(batch.column(2)))]
            n = [len(x) for x in ids]
            at = []
            for s, k in zip(queue, n, strict=True):
                at.append(counted[s])
                counted[s] += k
            small = enc.library.get_vocab_size() <= 1 << 16
            data = [(x.astype("<u2") if small else x).tobytes() for x in ids]
            rows = [(part << 40) + row + k for k in range(len(n))]
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), pa.array(queue, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64())],
                ["row_id", "doc_id", "queue", "n", "ids", "part", "at"],
            )

    read = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), _source_key(docs, source_col).alias("source"), F.col(quoted(text_col)).cast("string").alias("text"))
    return scratch.table(read.mapInArrow(tidy(run), "row_id long, doc_id long, queue int, n long, ids binary, part long, at long"), "tokens")


def handed_over(totals: list[int], position: int, weights: list[int] | None = None) -> list[int]:
    """What each queue has given when `position` tokens are packed: its share, whole, together exactly `position`.

    A queue's k-th token is due at (k + 1/2) / weight; the first `position`
    tokens by due time are packed, ties in queue order, queues of weight 0 last.
    Counts grow with `position` and stay within a token of the exact shares.
    """
    weights = list(totals) if weights is None else weights
    live = [t if w else 0 for t, w in zip(totals, weights, strict=True)]
    whole = sum(live)
    if position > whole:
        late = [t - x for t, x in zip(totals, live, strict=True)]
        return [x + y for x, y in zip(live, handed_over(late, min(position - whole, sum(late))) if sum(late) else late, strict=True)]
    if position <= 0:
        return [0] * len(totals)
    if position == whole:
        return live
    due = lambda x: [min(t, (w * x + ONE // 2) >> 128) for t, w in zip(live, weights, strict=True)]  # noqa: E731  tokens due at x / ONE
    low, high = 0, ONE * max((t + 1) // w + 1 for t, w in zip(live, weights, strict=True) if w)
    guess = int(_level(np.array(live, float), np.array(weights, float), np.array([position], float))[0] * 2**64) << 64
    for x in (guess - (guess >> 30), guess + (guess >> 30) + 1):
        if sum(due(x)) <= position:
            low = max(low, x)
        else:
            high = min(high, x)
    # halve until at most the tokens due at one time are in doubt
    finest = max(1, ONE // (4 * max(weights) ** 2))
    while high - low > finest:
        mid = (low + high) >> 1
        if sum(due(mid)) <= position:
            low = mid
        else:
            high = mid
    out, upper = due(low), due(high)
    for k in range(len(out)):
        out[k] += min(upper[k] - out[k], position - sum(out))
    return out


def _level(totals: np.ndarray, weights: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """x with sum(min(total, weight x)) = position, over queues of positive weight."""
    live = weights > 0
    if not live.any():
        return np.zeros(len(positions))
    ends = totals[live] / weights[live]
    order = np.argsort(ends, kind="stable")
    at = np.concatenate([[0], ends[order]])
    slope = np.maximum(weights[live].sum() - np.concatenate([[0], np.cumsum(weights[live][order])[:-1]]), 0)
    return np.interp(positions, np.concatenate([[0], np.cumsum(np.diff(at) * slope)]), at)


def earned(totals: np.ndarray, weights: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Exact shares, with fractions, of every queue (columns) at each position of the packed corpus (rows)."""
    totals, weights, positions = (x.astype(np.float64) for x in (totals, weights, positions))
    out = np.minimum(totals, np.outer(_level(totals, weights, positions), weights))
    late = np.where(weights > 0, 0, totals)
    if late.sum():
        out += np.outer(np.maximum(positions - (totals - late).sum(), 0), late / late.sum())
    return out


def deficit_rounds(totals: np.ndarray, before: np.ndarray, budget: np.ndarray, window: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Deficit round robin over one segment: tokens of each queue in each window.

    `before` is what the queues have given so far and fixes the deficits carried
    in; `budget` is what they give in this segment. Rows are windows.
    """
    weights = totals if weights is None else weights
    left, given = budget.astype(np.int64).copy(), before.astype(np.int64).copy()
    start, size = int(given.sum()), int(left.sum())
    ends = start + np.minimum(window * np.arange(1, -(-size // window) + 1), size)
    out = []
    for end, want in zip(ends.tolist(), earned(totals, weights, ends), strict=True):
        room, deficit = end - int(given.sum()), want - given
        take = np.minimum(np.maximum(np.floor(deficit + 1e-9), 0).astype(np.int64), left)
        while (over := int(take.sum()) - room) > 0:
            k = int(np.argmin(np.where(take > 0, deficit - take, np.inf)))
            take[k] -= min(over, int(take[k]))
        while (free := room - int(take.sum())) > 0:
            open_ = left > take
            order = np.argsort(np.where(open_, take - deficit, np.inf), kind="stable")[: min(free, int(open_.sum()))]
            take[order] += 1
        given += take
        left -= take
        out.append(take)
    return np.array(out, np.int64).reshape(-1, len(totals))


_PIECE = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_segment(frame: pd.DataFrame, totals: np.ndarray, weights: list[int], window: int, segment: int, width: int, keep_ids: bool) -> pd.DataFrame:
    """Pieces of one segment. frame: slices of documents, each with `at`, its place in its source's stream."""
    seg = int(frame["segment"].iloc[0])
    listed = [int(t) for t in totals]
    before, after = (np.array(handed_over(listed, (seg + k) * segment * window, weights), np.int64) for k in (0, 1))
    takes = deficit_rounds(totals, before, after - before, window, np.array(weights, np.float64))
    ends = before + np.cumsum(takes, axis=0)  # of each window in each stream
    first = np.cumsum(takes, axis=1) - takes  # of each queue in each window
    out = []
    for s, at, n, start, row, doc, whole, ids in zip(*(frame[c].tolist() for c in ("queue", "at", "len", "start", "row_id", "doc_id", "n", "ids")), strict=True):
        data = np.frombuffer(ids, f"<u{width}")
        w = int(np.searchsorted(ends[:, s], at, side="right"))
        done = 0
        while done < n:
            room = int(ends[w, s]) - (at + done)
            if room <= 0:
                w += 1
                continue
            k = min(room, n - done)
            inside = at + done - (int(ends[w, s]) - int(takes[w, s]))
            part = data[done : done + k].astype("<u4").tobytes()
            out.append((row, doc, start + done, k, zlib.crc32(part), whole, seg * segment + w, int(first[w, s]) + inside) + ((part,) if keep_ids else ()))
            done += k
    return pd.DataFrame(out, columns=[f.split()[0] for f in _PIECE.split(", ")] + ["ids"] * keep_ids).astype({"doc_id": "Int64"})


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", segment: int = SEGMENT, keep_ids: bool = False, targets: dict | None = None, queues: int = QUEUES
) -> DataFrame:
    """The pieces of all documents: row_id, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    targets: the share of each source in every window, {source: share}, as long
    as its queue lasts. A sequence is as long as its window but for the corpus's last one.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    source_col = source_col if source_col in docs.columns else None
    number = queue_numbers(docs, source_col, text_col, targets, queues)
    tokens = tokenized(docs, vocabulary, end_id, scratch, id_col, text_col, source_col, number)
    # One row for each queue and input partition; running sums give each its place in the stream.
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = np.zeros(len(number) + 1, np.int64)
    for r in parts.groupBy("queue").agg(F.sum("m").alias("m")).collect():  # a row for each queue
        totals[r["queue"]] = r["m"]
    weights = shares(number, targets, totals.tolist())
    whole, unit = int(totals.sum()), window * segment
    bases = parts.select("queue", "part", before.alias("base"))
    bases = scratch.table(bases, "bases")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).withColumn("at", F.col("at") + F.col("base")).drop("base", "part")
    # Where each queue's stream is cut into segments, one small array for each queue.
    segments = -(-whole // unit) if whole else 0
    width = 2 if encoder(vocabulary).library.get_vocab_size() <= 1 << 16 else 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        listed = [int(t) for t in totals]
        size, share = totals.astype(np.float64), np.array(weights, np.float64)
        early = float(size[share > 0].sum())

        def begins(g: int) -> list[int]:
            if g not in known:
                if len(known) * len(listed) > 1 << 20:
                    known.clear()
                known[g] = handed_over(listed, g * unit, weights)
            return known[g]

        for batch in slices(batches):
            out: list[tuple] = []
            for row, doc, s, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "queue", "n", "ids", "at")), strict=True):
                # the first guess is off by a segment at most: shares are kept within a token
                place = np.minimum(size, share * (at / share[s])).sum() if share[s] else early + at * (whole - early) / max(1, listed[s])
                g = min(max(0, int(place) // unit), segments - 1)
                while g and begins(g)[s] > at:
                    g -= 1
                done = 0
                while done < n:
                    while begins(g + 1)[s] <= at + done:
                        g += 1
                    k = min(n - done, begins(g + 1)[s] - at - done)
                    out.append((g, row, doc, s, n, done, k, at + done, ids[done * width : (done + k) * width]))
                    done += k
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CUT.types, strict=True)], schema=_CUT)

    pieces = placed.mapInArrow(tidy(cut), "segment long, row_id long, doc_id long, queue int, n long, start long, len long, at long, ids binary")
    return pieces.groupBy("segment").applyInPandas(lambda f: _pack_segment(f, totals, weights, window, segment, width, keep_ids), _PIECE + ", ids binary" * keep_ids)


_CUT = pa.schema([("segment", pa.int64()), ("row_id", pa.int64()), ("doc_id", pa.int64()), ("queue", pa.int32()), ("n", pa.int64()), ("start", pa.int64()), ("len", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])


def op2_deficit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json")).drop("row_id")

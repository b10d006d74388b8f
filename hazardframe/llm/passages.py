"""Suffix-array deduplication of passages across the corpus.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id. Such strings are found by longest-previous-factor
arrays over blocks of text that may match:

1. Copies of whole texts are folded, first inside each input partition. The
   distinct texts are dealt over parts by content hash (the one shuffle of text).
2. Every string of `length` bytes holds an anchor: a gram of `GRAM` bytes whose
   hash is least among the grams of that string, so equal strings have equal
   anchors at equal places. A part reports each of its anchors once.
3. Anchors met in two texts go back to the parts that hold them, with a
   signature of the set of holders. Neighbouring shared anchors with one
   signature become one run of text with all strings around them.
4. Runs of one signature meet in a task, which builds the suffix array of its
   block to the depth of `length` bytes by prefix doubling. In suffix order, the
   previous and the next suffix of a smaller document, as long as they agree in
   `length` bytes, say that the factor occurs earlier; those strings go.
5. A signature with more text than a task should hold (a passage in a third of
   all documents) is split by the strings themselves: every string belongs to
   its anchor, so the text around one anchor is a block that sorts alone. Equal
   cores of runs are folded to the least document first. Equal
   pieces of text, which are most of it, are folded to the least document
   before they meet. If so many different pieces hold one anchor that they are still
   too much, they are split by prefix to the full depth: suffixes of `length`
   bytes in Spark's own order of bytes, equal ones side by side, where a factor
   is earlier if a smaller document is in its run.

A string is judged on the input, so what one document loses never hides it from
another. Anchors can bring texts together that then match nowhere; they cannot
miss a match.

Defined results: a null text is empty. Copies with a larger id lose everything
if they have `length` bytes, else nothing. A null id counts as larger than any
other; rows that share an id do not take from each other. Texts shorter than
`length` bytes, whatever they hold, stay whole. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, all_of, hand_back, hot_join, slices, text_or_empty, tidy, utf8, without

LENGTH, GRAM = 50, 34
#: Bytes of text in a part, in a block that is sorted at once, and in one signature's or anchor's block at most.
PART_BYTES, BLOCK_BYTES, BLOCK_MOST = 8 << 20, 1 << 20, 2 << 20
#: Bytes of an anchor's hash kept beside its bucket's number; a clash only brings texts together in vain.
KEPT = 5
#: Texts that hold a piece of a large signature from which it is broadcast, and the most such pieces (100 bytes each).
OFTEN, OFTEN_MOST = 1000, 100_000
LAST = (1 << 63) - 1
_NONE = np.uint64((1 << 64) - 1)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes at every position that has so many."""
    factors = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
    size = 1
    for f in factors:
        if size == gram:
            break
        step = min(size, gram - size)
        h = (h[: len(h) - step] ^ (h[: len(h) - step] >> np.uint64(29))) * np.uint64(f) + h[step:]
        size += step
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width] for every such window, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = best(x[: len(x) - step], x[step:])
        size += step
    return x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts laid end to end; `ends` holds where each ends.

    A gram is an anchor if it is least among the grams of some `length` bytes.
    Grams across two texts are none.
    """
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _grams(data, gram)
    for e in ends[:-1].tolist():
        h[max(0, e - gram + 1) : e] = _NONE
    least = _sliding(h, width, np.minimum)  # of the grams of the string at i
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((most == h) & (h != _NONE))
    return at, h[at]


def _chunks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    first, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= limit:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def _anchored(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, position in it, hash) of the anchors, some texts at a time."""
    for first, part in _chunks(texts):
        sizes = np.array([len(t) for t in part], np.int64)
        ends = np.cumsum(sizes)
        at, h = anchors(np.frombuffer(b"".join(part), np.uint8), ends, length, gram)
        owner = np.searchsorted(ends, at, side="right")
        inside = at - (ends - sizes)[owner]
        yield owner + first, inside, h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _fold(batches: Iterator[pa.RecordBatch], limit: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Distinct texts of the partition with their hash and least ord, flushed when they hold `limit` bytes."""
    table: dict[bytes, list[int]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = list(table.items())
        for at in range(0, len(rows), 2048):
            part = rows[at : at + 2048]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for _, x in part], pa.int64()) for k in (0, 1)] + [pa.array([t for t, _ in part], pa.binary())], ["h", "ord", "text"])

    for batch in batches:
        for h, o, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            known = table.get(t)
            if known is None:
                table[t] = [h, o]
                held += len(t) + 200
            elif o < known[1]:
                known[1] = o
        if held > limit:
            yield from out()
            table, held = {}, 0
    yield from out()


def _units(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct texts of a part, each with its least ord and its hash."""
    least: dict[bytes, tuple[int, int]] = {}
    for h, o, t in zip(*(table.column(c).to_pylist() for c in ("h", "ord", "text")), strict=True):
        if t not in least or o < least[t][0]:
            least[t] = (o, h)
    return list(least), np.array([o for o, _ in least.values()], np.int64), np.array([h for _, h in least.values()], np.int64)


def _blobs(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array(columns[n], t) for n, t in types.items()})


def _bucketed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and what is kept of each hash."""
    return ((h >> np.uint64(8 * KEPT)) % np.uint64(buckets)).astype(np.int64), h & np.uint64((1 << 8 * KEPT) - 1)


def _to_blob(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def _from_blob(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(blob, np.uint8).reshape(-1, KEPT)
    return out.reshape(-1).view("<u8")


def _report(table: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """Each anchor of a part once, by bucket: hashes, and whether two of its texts have it."""
    hand_back()
    part = table.column("part")[0].as_py()
    texts, _, _ = _units(table)
    found = [(h, owner) for owner, _, h in _anchored(texts, length, gram)]
    types = {"bucket": pa.int64(), "part": pa.int64(), "hashes": pa.binary(), "several": pa.binary()}
    out: dict[str, list] = {n: [] for n in types}
    if found:
        h, owner = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        bucket, h = _bucketed(h, buckets)
        order = np.argsort(h | (bucket.astype(np.uint64) << np.uint64(8 * KEPT)))
        h, owner, bucket = h[order], owner[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(h) else np.zeros(0, bool)
        h, bucket = h[first], bucket[first]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(bucket) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            out["bucket"].append(int(bucket[a]))
            out["part"].append(part)
            out["hashes"].append(_to_blob(h[a:b]))
            out["several"].append(np.packbits(several[a:b]).tobytes())
    return _blobs(out, types)


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket, the anchors of two texts or more, for each part that holds them, with the holders' signature."""
    parts = np.array(table.column("part").to_pylist(), np.int64)
    bucket = table.column("bucket")[0].as_py()
    hashes = [_from_blob(x) for x in table.column("hashes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table.column("several").to_pylist(), hashes, strict=True)]
    h, several = np.concatenate(hashes), np.concatenate(several)
    holder = np.repeat(np.arange(len(parts)), [len(x) for x in hashes])
    order = np.argsort(h)
    h, several, holder = h[order], several[order], holder[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    with np.errstate(over="ignore"):
        signature = np.repeat(np.add.reduceat(_mix(parts)[holder], first), size)
    keep = np.repeat((size > 1) | np.logical_or.reduceat(several, first), size)
    h, signature, holder = h[keep], signature[keep], holder[keep]
    order = np.argsort(holder, kind="stable")
    h, signature, holder = h[order], signature[order], holder[order]
    types = {"part": pa.int64(), "bucket": pa.int64(), "hashes": pa.binary(), "signatures": pa.binary()}
    out: dict[str, list] = {n: [] for n in types}
    cuts = np.flatnonzero(np.concatenate([[True], holder[1:] != holder[:-1], [True]])).tolist() if len(h) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        out["part"].append(int(parts[holder[a]]))
        out["bucket"].append(bucket)
        out["hashes"].append(_to_blob(h[a:b]))
        out["signatures"].append(signature[a:b].tobytes())
    return _blobs(out, types)


_RUN = {"signature": pa.int64(), "ord": pa.int64(), "h": pa.int64(), "start": pa.int64(), "text": pa.binary(), "lead": pa.int64(), "tail": pa.int64()}
_RUN_DDL = "signature long, ord long, h long, start long, text binary, lead long, tail long"


def _runs(table: pa.Table, shared: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """The runs of a part: text with shared anchors, and all strings around them; `lead` and `tail` bytes lie outside all anchors."""
    hand_back()
    out: dict[str, list] = {n: [] for n in _RUN}
    if table.num_rows and shared.num_rows:
        # one number for bucket and kept hash: the bucket's low bits stand above the hash
        full = lambda b, h: h | (b.astype(np.uint64) << np.uint64(8 * KEPT))
        blobs = [_from_blob(x) for x in shared.column("hashes").to_pylist()]
        known = full(np.repeat(np.array(shared.column("bucket").to_pylist(), np.int64), [len(x) for x in blobs]), np.concatenate(blobs))
        sign = np.concatenate([np.frombuffer(x, "<u8") for x in shared.column("signatures").to_pylist()])
        order = np.argsort(known)
        known, sign = known[order], sign[order].view(np.int64)
        texts, ords, hs = _units(table)
        sizes = np.array([len(t) for t in texts], np.int64)
        for owner, at, h in _anchored(texts, length, gram):
            h = full(*_bucketed(h, buckets))
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[k] == h
            owner, at, sig = owner[hit], at[hit], sign[k[hit]]
            if not len(owner):
                continue
            order = np.lexsort((at, sig, owner))
            owner, at, sig = owner[order], at[order], sig[order]
            begin, end = np.maximum(at - (length - gram), 0), np.minimum(at + length, sizes[owner])
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (sig[1:] != sig[:-1]) | (begin[1:] > end[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            outside = ((at - begin)[first].tolist(), (end - at)[last] - gram)
            for u, s, a, b, lead, tail in zip(owner[first].tolist(), sig[first].tolist(), begin[first].tolist(), end[last].tolist(), outside[0], outside[1].tolist(), strict=True):
                if b - a >= length:
                    for name, x in zip(_RUN, (s, int(ords[u]), int(hs[u]), a, texts[u][a:b], lead, tail), strict=True):
                        out[name].append(x)
    return _blobs(out, _RUN)


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` bytes (a shorter one before what it begins), ties in any order; and each position's rank.

    Prefix doubling: ranks of 2k bytes come from ranks of k bytes at two places;
    the last step lets the two overlap to reach `depth` exactly. Ranks and the
    order take four bytes a position; only the key that is sorted takes eight.
    """
    n = len(data)
    rank, size = data.astype(np.int64) + 1, 1  # 0 is past the end
    while size < 4 and 2 * size <= depth:  # the first ranks are the bytes themselves, side by side
        rank = (rank << (9 * size)) | _ahead(rank, size)
        size *= 2
    order = np.argsort(rank).astype(np.int32)
    while size < depth:
        step = min(size, depth - size)
        dense = _dense(rank, order) + np.int32(1)
        rank = dense.astype(np.int64)
        rank <<= 32
        rank |= _ahead(dense, step)
        size += step
        order = np.argsort(rank).astype(np.int32)
    return order, _dense(rank, order)


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    """The rank `by` places on; 0 past the end."""
    out = np.zeros(len(rank), rank.dtype)
    out[: max(0, len(rank) - by)] = rank[by:]
    return out


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), np.int32)
    if len(key):
        ordered = key[order]
        out[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1], dtype=np.int32)
    return out


def smaller_neighbours(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before, and after, with a smaller value in the same group; -1 for none.

    Pointers jump over stretches of values that are no smaller, all places at once.
    """

    def previous(v: np.ndarray, g: np.ndarray) -> np.ndarray:
        n = len(v)
        at = np.arange(n) - 1
        at[np.concatenate([[True], g[1:] != g[:-1]])] = -1
        todo = np.flatnonzero(at >= 0)
        while len(todo):
            todo = todo[v[at[todo]] >= v[todo]]
            at[todo] = at[at[todo]]
            todo = todo[at[todo] >= 0]
        return at

    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    back = previous(values[::-1], group[::-1])[::-1]
    return previous(values, group), np.where(back >= 0, len(values) - 1 - back, -1)


def earlier_factors(data: np.ndarray, room: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Positions whose `length` bytes also start in a text with a smaller `owner`: longest previous factor >= length.

    `room` is the bytes left in the position's own text.
    """
    if len(data) < length:
        return np.zeros(0, np.int64)
    order, rank = suffix_ranks(data, length)
    order = order[room[order] >= length]
    if not len(order):
        return order
    group = rank[order]
    # a suffix that agrees with no neighbour in `length` bytes has no factor here
    same = group[1:] == group[:-1]
    met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, group = order[met], group[met]
    before, after = smaller_neighbours(owner[order], group)
    return np.sort(order[(before >= 0) | (after >= 0)]).astype(np.int64)


def _room(ends: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The bytes from each position to the end of its run."""
    out = ends.astype(np.int32)[run]
    out -= np.arange(len(run), dtype=np.int32)
    return out


def _spans(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [p, p + length) over sorted positions."""
    if not len(at):
        return at, at
    first = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + length]))
    return at[first], at[np.append(first[1:], len(at)) - 1] + length


_SPAN_DDL = "ord long, h long, begin long, end long"


def _solve(rows: list[tuple[int, int, int, bytes]], length: int) -> pa.RecordBatch:
    """Spans that go, of runs (ord, h, start, text)."""
    rows.sort(key=lambda r: r[:3])
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    owner = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1].astype(np.int32)
    at = earlier_factors(data, _room(ends, run), owner[run], length)
    out = []
    for k, begin, mine in _of_runs(at, ends, sizes):
        o, h, start, _ = rows[k]
        for a, b in zip(*(x.tolist() for x in _spans(mine, length)), strict=True):
            out.append((o, h, start + a - begin, start + b - begin))
    return _span_batch(out)


def _of_runs(at: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, begin, positions) of each run that has any of the sorted positions."""
    begins = ends - sizes
    lo, hi = np.searchsorted(at, begins), np.searchsorted(at, ends)
    for k in np.flatnonzero(hi > lo).tolist():
        yield k, int(begins[k]), at[lo[k] : hi[k]]


def _span_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["ord", "h", "begin", "end"])


def _solve_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by signature; blocks hold whole signatures."""
    rows: list[tuple] = []
    size, last = 0, None
    for batch in slices(batches, 1024):
        for s, o, h, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != last and size >= BLOCK_BYTES:
                yield _solve(rows, length)
                rows, size = [], 0
            last = s
            rows.append((o, h, start, text))
            size += len(text)
    if rows:
        yield _solve(rows, length)


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs cut by anchor: (anchor, piece, ord, h, at), the text with every string that holds the anchor, and where it begins.

    Neighbouring pieces overlap, so that each string is whole in the piece of its anchor.
    Of a copy of a core, only pieces with strings that are not whole in the core.
    """
    for batch in slices(batches, 256):
        o, h, start, text, copy, lead, tail = (batch.column(c).to_pylist() for c in ("ord", "h", "start", "text", "copy", "lead", "tail"))
        out: list[list] = [[] for _ in range(5)]
        for owner, at, found in _anchored(text, length, gram):
            begin = np.maximum(at - (length - gram), 0)
            for u, a, b, x in zip(owner.tolist(), begin.tolist(), (at + length).tolist(), found.view(np.int64).tolist(), strict=True):
                if copy[u] and a >= lead[u] and b <= len(text[u]) - tail[u]:
                    continue
                piece = text[u][a:b]
                if len(piece) >= length:
                    for column, value in zip(out, (x, piece, o[u], h[u], start[u] + a), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), *(pa.array(c, pa.int64()) for c in out[2:])], ["anchor", "piece", "ord", "h", "at"])


def _cut_pieces(rows: list[tuple[int, bytes, int]], length: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(anchor, piece, begin, end) of what goes from each different piece (least ord, piece, anchor) of a block."""
    sizes = np.array([len(p) for _, p, _ in rows], np.int64)
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    owner = np.unique(np.array([o for o, _, _ in rows], np.int64), return_inverse=True)[1].astype(np.int32)
    data = np.frombuffer(b"".join(p for _, p, _ in rows), np.uint8)
    at = earlier_factors(data, _room(ends, run), owner[run], length)
    for k, begin, mine in _of_runs(at, ends, sizes):
        for a, b in zip(*(x.tolist() for x in _spans(mine - begin, length)), strict=True):
            yield rows[k][2], rows[k][1], a, b


def _piece_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, piece, least) come sorted by anchor; a block holds whole anchors."""
    rows: list[tuple[int, bytes, int]] = []
    size, last = 0, None

    def out() -> pa.RecordBatch:
        found = list(_cut_pieces(rows, length))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["anchor", "piece", "begin", "end"])

    for batch in slices(batches, 1024):
        for anchor, piece, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if anchor != last and size >= BLOCK_BYTES:
                yield out()
                rows, size = [], 0
            last = anchor
            rows.append((least, piece, anchor))
            size += len(piece)
    if rows:
        yield out()


def _piece_suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(suffix, least, anchor, piece, at): the suffixes of each piece to the depth of `length` bytes."""
    for batch in slices(batches, 256):
        out = [(p[i : i + length], o, a, p, i) for a, p, o in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i in range(len(p) - length + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["suffix", "least", "anchor", "piece", "at"])


def _solve_split(hot: DataFrame, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """Spans of signatures that are too large for one block, by the pieces around their anchors.

    What lies from a run's first anchor to the end of its last, its core, is one text in all that copied the
    same passage. Equal cores are folded first: all but those of the least document go whole.
    """
    size = F.octet_length("text") - F.col("lead") - F.col("tail")
    core = F.expr("substring(text, cast(lead + 1 as int), cast(octet_length(text) - lead - tail as int))")
    hot = scratch.table(hot.withColumn("core", F.when(size >= length, F.sha2(core, 256))), "cored")
    cores = scratch.table(hot.where("core is not null").groupBy("core").agg(F.min("ord").alias("least"), F.count("*").alias("n")).where("n > 1"), "cores")
    hot = hot_join(hot, cores.select("core", "least"), ["core"], cores.select("core", "n"), "left").withColumn("copy", F.coalesce(F.col("ord") > F.col("least"), F.lit(False)))
    hot = scratch.table(hot.select(*_RUN, "copy"), "folded")
    whole_cores = hot.where("copy").select("ord", "h", (F.col("start") + F.col("lead")).alias("begin"), (F.col("start") + F.octet_length("text") - F.col("tail")).alias("end"))
    pieces = scratch.table(hot.mapInArrow(tidy(lambda it: _pieces(it, length, gram)), "anchor long, piece binary, ord long, h long, at long"), "pieces")
    # copies are folded inside each input partition, so a piece of a third of all documents is one row for each
    first = scratch.table(pieces.groupBy("anchor", "piece").agg(F.min("ord").alias("least"), F.count("*").alias("n")), "first")
    large = first.groupBy("anchor").agg(F.sum(F.octet_length("piece")).alias("size")).where(F.col("size") > BLOCK_MOST).select("anchor")
    large = scratch.table(large, "large")
    usual = first.join(large, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").select("anchor", "piece", "least")
    cut = usual.mapInArrow(tidy(lambda it: _piece_blocks(it, length)), "anchor long, piece binary, begin long, end long")
    if not large.isEmpty():
        suffixes = first.join(large, "anchor", "left_semi").select("anchor", "piece", "least").mapInArrow(tidy(lambda it: _piece_suffixes(it, length)), "suffix binary, least long, anchor long, piece binary, at long")
        suffixes = scratch.table(suffixes, "suffixes")
        runs = suffixes.groupBy("suffix").agg(F.min("least").alias("owner"))
        gone = suffixes.join(runs, "suffix").where("owner < least")
        cut = cut.union(gone.select("anchor", "piece", F.col("at").alias("begin"), (F.col("at") + length).alias("end")))
    # of the least document of a piece what its block says goes; of all others the whole piece
    on = ["anchor", "piece"]
    cut = cut.groupBy(*on).agg(F.collect_set(F.struct("begin", "end")).alias("cuts"))
    known = scratch.table(first.join(cut, on, "left").where("n > 1 or cuts is not null").select(*on, "least", "n", "cuts"), "known")
    often = known.where(F.col("n") > OFTEN)
    if often.isEmpty():
        met = pieces.join(known.drop("n"), on)
    else:  # what very many texts hold, the commonest first, is looked up where they are, not dealt by the piece
        often = scratch.table(often.orderBy(F.col("n").desc(), *on).limit(OFTEN_MOST).drop("n"), "often")
        names = F.broadcast(often.select(*on))
        seldom = known.drop("n").join(names, on, "left_anti")
        met = pieces.join(F.broadcast(often), on).union(pieces.join(names, on, "left_anti").join(seldom, on).select(*on, "ord", "h", "at", "least", "cuts"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length("piece").cast("long").alias("end")))
    spans = met.where("ord > least or cuts is not null").select("ord", "h", "at", F.explode(F.when(F.col("ord") > F.col("least"), whole).otherwise(F.col("cuts"))).alias("c"))
    return whole_cores.union(spans.select("ord", "h", (F.col("at") + F.col("c.begin")).alias("begin"), (F.col("at") + F.col("c.end")).alias("end")))


def passage_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(ord, h, begins, ends): what goes from the text of hash h whose least id is ord, as spans that may overlap."""
    scratch = Scratch(docs.sparkSession, "passages")
    whole = _keyed(docs, id_col, text_col)
    total = whole.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    dealt = whole.where(F.octet_length("text") >= length).mapInArrow(tidy(_fold), "h long, ord long, text binary").withColumn("part", F.pmod(F.shiftright("h", 7), F.lit(parts)))
    by_part = dealt.groupBy("part")
    reported = by_part.applyInArrow(lambda t: _report(t, parts, length, gram), "bucket long, part long, hashes binary, several binary")
    shared = reported.groupBy("bucket").applyInArrow(_shared, "part long, bucket long, hashes binary, signatures binary")
    runs = by_part.cogroup(shared.groupBy("part")).applyInArrow(lambda a, b: _runs(a, b, parts, length, gram), _RUN_DDL)
    runs = scratch.table(runs, "runs")
    hot = runs.groupBy("signature").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > BLOCK_MOST).select("signature")
    hot = scratch.table(hot, "hot")
    usual = runs.drop("lead", "tail").join(hot, "signature", "left_anti").repartition("signature").sortWithinPartitions("signature")
    spans = usual.mapInArrow(tidy(lambda it: _solve_blocks(it, length)), _SPAN_DDL)
    if not hot.isEmpty():
        spans = spans.union(_solve_split(runs.join(hot, "signature"), length, gram, scratch))
    return spans.groupBy("ord", "h").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, ord, text): Spark's hash of the text, the id with null above all others, the text with null empty."""
    text = text_or_empty(text_col)
    return docs.select(F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), text.alias("text"))


@F.pandas_udf(T.StructType([T.StructField("removed", T.LongType()), T.StructField("spans", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("text", T.StringType())]))
def _cut(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Bytes and runs removed, and what is left, of texts that are not null; as text too where U+FFFD stood before."""
    out = []
    for t, first, last in zip(text, begins, ends, strict=True):
        if t is None or first is None:
            out.append((None, None, None, None))
            continue
        data, spans = t.encode(), []
        for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        kept, at = [], 0
        for a, b in spans:
            kept.append(data[at:a])
            at = b
        left = b"".join(kept) + data[at:]
        out.append((len(data) - len(left), len(spans), left, left.decode("utf-8", "ignore") if "\ufffd" in t else None))
    return pd.DataFrame(out, columns=["removed", "spans", "kept", "text"]).astype({"removed": "Int64", "spans": "Int64"})


def marked(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int = GRAM) -> DataFrame:
    """`docs` with __copy (all of it goes) and __cut (removed, spans, kept, text; null where nothing goes).

    What a text loses is joined to rows by the digest of the whole text; rows of a
    very common text are dealt over many tasks. Only texts with spans reach Python again.
    """
    text = text_or_empty(text_col)
    rows = docs.withColumns({"__sha": F.sha2(text, 256), "__ord": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__h": F.xxhash64(text)})
    per_text = rows.groupBy("__sha").agg(F.min("__ord").alias("__first"), F.min("__h").alias("__hash"), F.count("*").alias("n"))
    counts = per_text = Scratch(docs.sparkSession, "texts").table(per_text, "texts")
    spans = passage_spans(docs, id_col, text_col, length, gram)
    per_text = per_text.join(spans, (F.col("__first") == F.col("ord")) & (F.col("__hash") == F.col("h")), "left").select("__sha", "__first", "begins", "ends")
    met = hot_join(rows, per_text.withColumnsRenamed({"begins": "__begins", "ends": "__ends"}), ["__sha"], counts.select("__sha", "n"))
    first = F.col("__ord") == F.col("__first")
    met = met.withColumn("__copy", ~first & (F.octet_length(text) >= length))
    return met.withColumn("__cut", _cut(F.when(first & F.col("__begins").isNotNull(), text), "__begins", "__ends"))


REPORT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row's id with n_bytes, n_removed, n_spans and kept_sha256."""
    rows = marked(docs.select(id_col, text_col), id_col, text_col, length)
    n = F.octet_length(text_or_empty(text_col)).cast("long")
    return rows.select(
        F.col(id_col).cast("long").alias(id_col),
        n.alias("n_bytes"),
        F.when(F.col("__copy"), n).otherwise(F.coalesce("__cut.removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("__copy"), F.lit(1)).otherwise(F.coalesce("__cut.spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("__copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("__cut.kept", 256), "__sha")).alias("kept_sha256"),
    )


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the text that is left; bytes of characters that were cut through are dropped."""
    rows = marked(docs, id_col, text_col, length)
    left = F.when(F.col("__copy"), F.lit("")).when(F.col("__cut.kept").isNotNull(), F.coalesce("__cut.text", valid_utf8("__cut.kept"))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, left).select(*all_of(docs))


def valid_utf8(column: str):
    """The bytes as text, without those that are not whole characters."""
    return F.regexp_replace(F.make_valid_utf8(F.col(column).cast("string")), "�", "")


def op3_passages(spark, sf_dir: str) -> DataFrame:
    return passage_report(without(spark.read.parquet(f"{sf_dir}/documents.parquet"), REPORT))

"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

A fingerprint has one or more words of 64 bits. For a small radius r they are
cut into m parts; two that differ in at most r bits agree in at least m - r
parts, so each is looked up once under every choice of m - r parts and no link
is missed. m follows from the number of distinct fingerprints and keeps groups
small. For texts of a given similarity, not a given distance, the look-ups are
least hashes of the shingles, the radius is wide, and what it lets through is
confirmed by the shingles themselves. A group that is still large (a text family a third of
the corpus wide) is cut into chunks and every two chunks meet in a task.

Inside a task the fingerprints are stored as vertical bit planes, one bit of a
word for each. Shifting the planes by d sets every row against the row d
further on; plane by plane the differing bits enter carry-save counters, 64
distances to a word, and a block of lanes is abandoned once all its counters
exceed the radius. Found links go through a union-find that passes on a
spanning forest only, never all pairs of a group.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other. Fewer words than a shingle needs make
one shingle of the whole sequence. Rows with a null id take part in links and
have the least non-null id reachable, or null if there is none. Repeated rows
get the same answer. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, all_of, hot_join, quoted, slices, text_or_empty, tidy, utf8, without
from .components import connected_components

RADIUS = 3
#: Look-up keys of a set of shingles and least hashes in each: a pair at Jaccard 0.8 shares none with a chance of 5e-6.
TABLES, ROWS = 40, 6
#: Standard deviations that the radius lies beyond the mean distance of a pair at the similarity asked for.
DEVIATIONS = 8
#: Fingerprints that one group may hold before it is cut into chunks, and lanes of a block.
GROUP, BLOCK = 4096, 1 << 16
#: Shingles that a component of candidates may hold before it is cut into chunks.
SHINGLES = 1 << 20
#: A chunk meets itself and every other once: task numbers of all unordered pairs that hold it.
MEETING = "explode(transform(sequence(0L, coalesce(chunks, 1L) - 1), x -> least(x, chunk) * coalesce(chunks, 1L) + greatest(x, chunk)))"
BITS = 64


def _words_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit hashes of each shingle from its first."""
    out = [hashes]
    for k in range(1, words):
        x = (hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(32)))
    return np.stack(out, axis=1)


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit: full adders on whole words while there are many rows, then one by one."""
    total, weight = np.zeros(BITS * rows.shape[1], np.int64), 1
    while len(rows):
        carries = []
        while len(rows) >= 96:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * k :]])
        bits = np.unpackbits(np.ascontiguousarray(rows, "<u8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.uint8).astype(np.int64)
        rows, weight = np.concatenate(carries) if carries else rows[:0], 2 * weight
    return total


def shingle_hashes(data: bytes, width: int, seed: int) -> np.ndarray:
    """A hash of each run of `width` words of a text in UTF-8: words between ASCII white space, A-Z in lower case."""
    digest, out, words = xxhash.xxh64_intdigest, [], []
    for part in _stretches(data):
        words += part.lower().split()
        columns = [words[k : max(0, len(words) - width + 1) + k] for k in range(width)]
        out.append(np.fromiter((digest(b" ".join(s), seed) for s in zip(*columns)), "<u8", len(columns[0])))  # noqa: B905
        if len(words) >= width:
            words = words[len(words) - width + 1 :]
    hashes = np.concatenate(out) if out else np.zeros(0, "<u8")
    return hashes if len(hashes) or not words else np.array([digest(b" ".join(words), seed)], "<u8")


def _stretches(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in stretches of about `size` bytes that end at white space, so a very long one is never held as words at once."""
    at = 0
    while len(data) - at > size:
        end = min((e for c in b" \n\t\r\v\f" if (e := data.find(c, at + size)) >= 0), default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def fingerprint(hashes: np.ndarray, size: int = 1) -> np.ndarray:
    """`size` words: the bits that more than half of the hashes have."""
    ones = np.zeros(BITS * size, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += bit_counts(_words_of(hashes[at : at + 8192], size))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def simhash(data: bytes, width: int, seed: int, size: int = 1) -> np.ndarray:
    """The fingerprint of a text in UTF-8, `size` words; zero for a text without words."""
    return fingerprint(shingle_hashes(data, width, seed), size)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, size: int = 1) -> DataFrame:
    """(id, h, f0, f1, ..): a hash of the text, and the words of each fingerprint as signed longs."""
    names = [f"f{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([simhash(t, width, seed, size) for t in utf8(batch.column(1))], np.uint64).reshape(-1, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(size))], ["id", "h", *names])

    whole = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), whole.alias("text"), F.xxhash64(whole).alias("h")).mapInArrow(tidy(run), ", ".join(["id long, h long", *(f"{n} long" for n in names)]))


class Forest:
    """Union-find over row numbers; `join` returns the pairs that connected something."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p
        return p

    def _root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        roots = self.roots()
        apart = roots[a] != roots[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            rx, ry = self._root(x), self._root(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
        return out


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprints (rows of words) a row of packed bits, the lanes little-endian in 64-bit words, with a word of padding."""
    columns = np.ascontiguousarray(np.ascontiguousarray(fps.astype("<u8").reshape(len(fps), -1)).view(np.uint8).T)
    out = np.zeros((8 * len(columns), (len(fps) + 63) // 64 + 1), "<u8")
    packed = out.view(np.uint8)
    for j, column in enumerate(columns):
        for b in range(8):
            bits = np.packbits(column & np.uint8(1 << b), bitorder="little")
            packed[8 * j + b, : len(bits)] = bits
    return out


def _shifted(plane: np.ndarray, by: int, words: int) -> np.ndarray:
    whole, rest = divmod(by, 64)
    out, low = np.zeros(words, "<u8"), plane[whole : whole + words]
    out[: len(low)] = low >> np.uint64(rest)
    if rest:
        high = plane[whole + 1 : whole + 1 + words]
        out[: len(high)] |= high << np.uint64(64 - rest)
    return out


def within_radius(planes: np.ndarray, by: int, wanted: np.ndarray, radius: int, fps: np.ndarray) -> np.ndarray:
    """Lanes i of `wanted` (packed) whose row of `fps` differs from row i + by in at most `radius` bits.

    Eight planes at a time pass through carry-save adders into counters, where
    counters[k] is bit k of every lane's distance; `over` marks lanes past the radius. A block is abandoned once all its lanes
    are over; when few are left, their distances are taken from the words.
    """
    words = len(wanted)
    counters = [np.zeros(words, "<u8") for _ in range(max(4, radius.bit_length()))]
    over = ~wanted
    for p in range(0, len(planes), 8):
        x = [planes[q, :words] ^ _shifted(planes[q], by, words) for q in range(p, p + 8)]
        ones, a = _add(counters[0], x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, c = _add(counters[1], a, b)
        ones, a = _add(ones, x[4], x[5])
        counters[0], b = _add(ones, x[6], x[7])
        counters[1], d = _add(twos, a, b)
        counters[2], carry = _add(counters[2], c, d)
        for k in range(3, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 16 == 8:
            over |= _exceeds(counters, radius)
            if (left := int(np.bitwise_count(~over).sum())) <= words:
                if not left:
                    return np.zeros(0, np.int64)
                break
    else:
        over |= _exceeds(counters, radius)
    i = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
    return i[np.bitwise_count(fps[i] ^ fps[i + by]).sum(axis=1, dtype=np.int64) <= radius]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full adder on 64 lanes a word: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than `radius`, from the high bit down."""
    larger, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            larger |= equal & counters[k]
            equal &= ~counters[k]
    return larger


def forest_links(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links among rows of equal `group` (sorted) within the radius.

    Rows that the forest connects already are not compared again, so a family of
    near copies costs few comparisons however large it is.
    """
    fps = np.ascontiguousarray(fps.astype("<u8").reshape(len(fps), -1))
    forest, out = Forest(len(fps)), []
    _, first, size = np.unique(group, return_index=True, return_counts=True)
    left = np.repeat(first + size, size) - np.arange(len(group)) - 1  # rows of the group after this one
    sizes, rows = np.repeat(size, size), np.arange(len(group))
    for by in range(1, int(size.max())):
        if by & (by - 1) == 0:  # groups too small for this shift leave the lanes
            rows = rows[sizes[rows] > by]
            here, ahead = fps[rows], left[rows]
            planes = bit_planes(here)
        roots = forest.roots()[rows]
        lanes = (ahead >= by) & (roots != np.append(roots[by:], np.full(min(by, len(roots)), -1))[: len(roots)])
        for at in np.unique(np.flatnonzero(lanes) // BLOCK).tolist():
            at *= BLOCK
            part = lanes[at : at + BLOCK]
            wanted = np.zeros((len(part) + 63) // 64 * 8, np.uint8)
            bits = np.packbits(part, bitorder="little")
            wanted[: len(bits)] = bits
            window = planes[:, at // 64 : (at + BLOCK + by) // 64 + 2]
            i = within_radius(window, by, wanted.view("<u8"), radius, here[at:]) + at
            if len(i):
                out += forest.join(rows[i], rows[i + by])
    return out


def part_masks(parts: int, radius: int = RADIUS) -> list[int]:
    """Signed masks of every choice of `parts - radius` of the equal parts of a fingerprint."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    single = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(parts)]
    whole = [sum(c) for c in combinations(single, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def parts_for(n: int, radius: int = RADIUS, fill: int = 64) -> int:
    """The least number of parts whose looked-up bits leave about `fill` of n spread fingerprints a group."""
    for parts in range(radius + 1, 4 * radius + 1):
        if BITS * (parts - radius) // parts >= np.log2(max(n, 2) / fill):
            return parts
    return 4 * radius


def min_keys(hashes: np.ndarray, seed: int = 1) -> np.ndarray:
    """`TABLES` look-up keys of a set of hashes, each from the least of the set under `ROWS` orders; no keys for an empty set.

    Two sets share a key with the chance similarity ** ROWS, whatever their sizes and however many sets there are.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    draws = rng.integers(0, 1 << 64, (3, TABLES * ROWS), np.uint64) | np.uint64(1)
    least = np.array([((hashes ^ x) * m).min() for x, m in zip(draws[0], draws[1], strict=True)], np.uint64)
    keys = (least * draws[2]).reshape(TABLES, ROWS).sum(axis=1, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (choice, bits, pair, words.., node) come sorted by group; a group that a batch leaves open waits for the next."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((np.diff(rows[:, :3], axis=0) != 0).any(axis=1))])
        alone = np.bincount(group)[group] == 1
        rows, group = rows[~alone], group[~alone]
        links = forest_links(group, rows[:, 3:-1].astype(np.uint64), radius) if len(rows) else []
        a, b = (np.array([rows[x[k], -1] for x in links], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    waiting = 0
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        held.append(rows)
        waiting += len(rows)
        if waiting < 1 << 16:
            continue
        rows = np.concatenate(held)
        same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
        cut = len(rows) - int(same.sum())
        if cut:
            yield solve(rows[:cut])
        held, waiting = [rows[cut:]], len(rows) - cut
    if waiting:
        yield solve(np.concatenate(held))


def near_links(known: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span every group of near fingerprints. known: written (f0, .., node), fingerprints distinct."""
    masks = part_masks(parts_for(known.count(), radius), radius)
    choices = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("f0").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])).alias("k")
    words = [c for c in known.columns if c != "node"]
    return _met_links(known.select(*words, "node", choices).select("k.*", *words, "node"), words, scratch, radius)


def candidate_links(known: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Links (a, b) that span all pairs which share a key and lie within the radius. known: written (f0, .., node, keys)."""
    words = [c for c in known.columns if c not in ("node", "keys")]
    keyed = known.select("node", F.posexplode("keys").alias("choice", "bits"))
    # most keys belong to one node: only the others need their fingerprints
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1").select("choice", "bits")
    keyed = scratch.table(keyed.join(shared, ["choice", "bits"], "left_semi"), "keyed")
    return _met_links(keyed.join(known.drop("keys"), "node").select("choice", "bits", *words, "node"), words, scratch, radius)


def _met_links(keyed: DataFrame, words: list[str], scratch: Scratch, radius: int) -> DataFrame:
    large = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    large = scratch.table(large.select("choice", "bits", F.ceil(F.col("n") * 2 / GROUP).alias("chunks")), "large")
    met = keyed.join(large, ["choice", "bits"], "left").withColumn("chunk", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))))
    dealt = met.select("choice", "bits", F.expr(MEETING).alias("pair"), *words, "node")
    sorted_ = dealt.repartition("choice", "bits", "pair").sortWithinPartitions("choice", "bits", "pair", *words)
    return sorted_.mapInArrow(tidy(lambda it: _links(it, radius)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, size: int = 1, radius: int = RADIUS) -> DataFrame:
    """(id, h, f0, .., component_id) of every row; h is the text's xxhash64."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, id_col, text_col, width, seed, size), "fingerprints")
    words = rows.columns[2:]
    # numbered once, when written: ids may repeat or be null, so they cannot name fingerprints
    named = rows.groupBy(*words).agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    named = scratch.table(named, "distinct")
    found = connected_components(near_links(named.drop("least", "n"), scratch, radius), scratch)
    return _least_ids(rows, named, words, found, scratch).select(F.col("id").alias(id_col), "h", *words, "component_id")


def _least_ids(rows: DataFrame, named: DataFrame, keys: list[str], found: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` with component_id, the least id of all whose `keys` name a node of the same component. named: keys, node, least and n, the rows of the keys."""
    classes = named.join(found, "node", "left").select(*keys, "least", F.coalesce("component", "node").alias("component"))
    classes = scratch.table(classes, "classes")
    names = scratch.table(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    known = hot_join(classes, names.drop("n"), ["component"], names.select("component", "n")).select(*keys, "component_id")
    return hot_join(rows, known, keys, named.select(*keys, "n"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int, size: int) -> DataFrame:
    """(id, h, d0, d1, shingles, f0, .., keys): a hash of the text, the digest and the size of its set of shingles, the words of that set's fingerprint and its look-up keys."""
    names = ["id", "h", "d0", "d1", "shingles", *(f"f{k}" for k in range(size))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, width, seed)) for t in utf8(batch.column(1))]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") for x in sets], np.int64).reshape(-1, 2)
            fp = np.array([fingerprint(x, size) for x in sets], np.uint64).reshape(-1, size).view(np.int64)
            values = np.column_stack([digests, np.array([len(x) for x in sets], np.int64), fp])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(v)) for v in values.T), pa.array([min_keys(x) for x in sets], pa.list_(pa.int64()))], [*names, "keys"])

    whole = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), whole.alias("text"), F.xxhash64(whole).alias("h")).mapInArrow(tidy(run), ", ".join([*(f"{n} long" for n in names), "keys array<long>"]))


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning links among sets (distinct hashes) whose Jaccard similarity is `similarity` or more, counted exactly.

    Only links that hold enter the forest, and only rows that such links connect
    already are not compared again.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    forest, out, everyone = Forest(len(sets)), [], np.arange(len(sets))
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    having = np.repeat(everyone, sizes)[np.argsort(ids, kind="stable")]  # rows that have hash 0, then 1, ..
    count = np.bincount(ids)
    first = np.cumsum(count) - count
    ends = np.searchsorted(sizes * similarity - 1e-6, sizes, side="right")  # larger sets cannot be similar
    for i in range(len(sets)):
        others = everyone[i + 1 : ends[i]]
        if not len(others):
            continue
        roots = forest.roots()
        others = others[roots[others] != roots[i]]
        if not len(others):
            continue
        mine = ids[starts[i] : starts[i + 1]]
        n = count[mine]
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.bincount(having[at], minlength=len(sets))[others]
        near = others[both / (sizes[i] + sizes[others] - both) >= similarity]
        out += forest.join(np.full(len(near), i), near)
    return [(int(order[a]), int(order[b])) for a, b in out]


def _confirmed(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, pair, node, shingles) come sorted; a node that comes again with an equal text counts once."""
    held, nodes, sets = None, [], []

    def solve() -> pa.RecordBatch:
        links = similar_links(sets, similarity) if len(sets) > 1 else []
        a, b = (np.array([nodes[x[k]] for x in links], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in slices(batches):
        for component, pair, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held != (component, pair):
                if len(sets) > 1:
                    yield solve()
                held, nodes, sets = (component, pair), [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(np.frombuffer(data, "<u8"))
    yield solve()


def confirmed_links(docs: DataFrame, id_col: str, text_col: str, named: DataFrame, found: DataFrame, scratch: Scratch, similarity: float, width: int, seed: int) -> DataFrame:
    """Links (a, b) that span all pairs at `similarity` or more within each component of `found`, the candidates.

    named: written (h, id, shingles, node): hash and id of one row with the node's shingles, and their number; only that
    row's text is read again, however many have it. A component that is large is cut into chunks, and every two chunks
    meet in a task.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__id")
    blocks = scratch.table(found.join(named.select("node", "h", key("id"), F.col("shingles").alias("size")), "node"), "blocks")
    chunks = F.greatest(F.ceil(F.sum("size") / SHINGLES), F.ceil(F.count("*") / GROUP))
    large = scratch.table(blocks.groupBy("component").agg(chunks.alias("chunks")).where("chunks > 1"), "large-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, width, seed)).tobytes() for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["component", "node", "shingles"])

    whole = text_or_empty(text_col)
    rows = docs.select(F.xxhash64(whole).alias("h"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("__id"), whole.alias("text"))
    met = rows.join(blocks, ["h", "__id"]).select("component", "node", "text")
    sets = met.mapInArrow(tidy(run), "component long, node long, shingles binary")
    cut = sets.join(large, "component", "left").withColumn("chunk", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))))
    dealt = cut.select("component", F.expr(MEETING).alias("pair"), "node", "shingles")
    sorted_ = dealt.repartition("component", "pair").sortWithinPartitions("component", "pair", "node")
    return sorted_.mapInArrow(tidy(lambda it: _confirmed(it, similarity)), "a long, b long")


def similar_agreement(similarity: float) -> float:
    """How often bits agree for two shingle sets of equal size and such a Jaccard similarity: by the angle of their vectors."""
    return 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, size: int = 8, seed: int = 42) -> DataFrame:
    """Membership (id, h, component_id) of every row: h is the text's xxhash64, component_id the least id reachable by links of Jaccard `similarity` or more.

    Pairs that share a look-up key and have near fingerprints (`size` words) are
    candidates only: within each of their components the links are those that the
    shingles themselves confirm. The radius lies `DEVIATIONS` beyond the mean
    distance of a pair at `similarity`.
    """
    agree = similar_agreement(similarity)
    bits = BITS * size
    radius = int(bits * (1 - agree) + DEVIATIONS * np.sqrt(bits * agree * (1 - agree)))
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.table(shingle_sets(docs, id_col, text_col, width, seed, size), "sets")
    words = rows.columns[5:-1]
    # a node is a set of shingles; equal sets may have unequal texts, of which one is read again
    same = [F.first(c).alias(c) for c in ("shingles", *words, "keys")]
    named = rows.groupBy("d0", "d1").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min(F.struct("h", "id")).alias("one"), *same).withColumn("node", F.monotonically_increasing_id())
    named = scratch.table(named.select("*", "one.h", "one.id").drop("one"), "distinct")
    candidates = connected_components(candidate_links(named.select(*words, "node", "keys"), scratch, radius), scratch)
    links = confirmed_links(docs, id_col, text_col, named, candidates, scratch, similarity, width, seed)
    confirmed = Scratch(docs.sparkSession, "confirmed")
    return _least_ids(rows, named, ["d0", "d1"], connected_components(links, confirmed), confirmed).select("id", "h", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, size: int = 8, seed: int = 42) -> DataFrame:
    """The rows of `docs` less all but one of each group of `near_groups`.

    The row with the least id stays; a group whose ids are all null stays whole.
    Rows that repeat the kept id and text all stay.
    """
    classes = near_groups(docs, id_col, text_col, similarity, width, size, seed)
    key = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    kept = classes.where("component_id is null or id = component_id").groupBy(key("id").alias("__key"), F.col("h").alias("__h")).agg(F.count("*").alias("n"))
    kept = Scratch(docs.sparkSession, "kept").table(kept, "kept")
    rows = docs.withColumn("__key", key(id_col)).withColumn("__h", F.xxhash64(text_or_empty(text_col)))
    return hot_join(rows, kept.drop("n"), ["__key", "__h"], kept).select(*all_of(docs))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = without(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["fingerprint", "component_id"])
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")

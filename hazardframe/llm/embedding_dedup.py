"""Embedding near-duplicates by randomised-rotation binary codes.

Equal vectors are folded first. Each distinct vector is coded once and stored
with its code: the unit vector goes through as many seeded random rotations as
make `CODE_BITS` coordinates, and of these the signs are packed (the code), with
a correction factor, the inner product of the vector and its signs. For the
other side of a comparison, the same coordinates are rounded at random to
`LEVEL_BITS` bits and packed as bit planes. Popcounts of code and planes,
divided by the factor, estimate the inner product without bias, with a
confidence bound; with `exact` the bound is one that always holds, from the
angles between a vector, its signs and the other vector.

Codes meet in buckets: `planned` says for each label and dimension how many bits of
the code leave `BUCKET` of its vectors a bucket, and how many such sets keep the
chance to miss a pair at the threshold under `MISS`. A label that fits a bucket is
compared whole, whatever the size of the others, and with `exact` every label is. A pair that meets in several sets counts in the
first. A bucket above two `CHUNK`s is cut into chunks, and every two chunks meet in
a task. Only vectors that some estimate leaves in doubt are fetched to such a
meeting, where every pair is computed in double precision; nothing is linked on
an estimate alone.

Defined results: labels must be equal and not null, and dimensions equal.
Vectors that are null, empty, zero, or hold a null or non-finite component link
with nothing and stand for themselves. Rows may repeat a vec_id; a null vec_id
takes part and never is a component's name unless nothing else is in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, quoted, slices, tidy
from .components import connected_components
from .simhash import Forest

THRESHOLD = 0.93
#: Width of the confidence interval in standard deviations: larger misses less and computes more.
CONFIDENCE = 4.0
#: Least bits of a code, and bits of a rounded coordinate on the other side.
CODE_BITS, LEVEL_BITS = 256, 4
BUCKET, CHUNK, MISS, SEED = 8192, 2048, 1e-4, 97
REPORT = ["n_links", "component_id", "kept"]


@lru_cache(maxsize=16)
def rotations(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices one below the other, scaled so that lengths stay."""
    rng, count = np.random.default_rng(seed), max(1, -(-CODE_BITS // dim))
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out) / math.sqrt(count)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Codes:
    """Codes of some vectors: signs, factors, bit planes of the rounded coordinates with their scale, and what rounding lost."""

    NUMBERS = ("factor", "low", "step", "lost")

    def __init__(self, signs: np.ndarray, planes: np.ndarray, numbers: np.ndarray, size: int):
        self.signs, self.planes, self.size = signs, planes, size
        self.factor, self.low, self.step, self.lost = numbers.T
        self.ones = np.bitwise_count(signs).sum(axis=1, dtype=np.int64)
        self.total = sum((1 << p) * np.bitwise_count(planes[:, p]).sum(axis=1, dtype=np.int64) for p in range(planes.shape[1]))

    @classmethod
    def of(cls, unit: np.ndarray, seed: int = SEED) -> Codes:
        turned = unit @ rotations(unit.shape[1], seed).T
        n, size = turned.shape
        low, top = turned.min(axis=1), (1 << LEVEL_BITS) - 1
        step = np.maximum((turned.max(axis=1) - low) / top, 1e-12)
        # rounded up with the chance of the fraction, drawn from the vector itself: the same in every task
        draws = ((np.abs(turned) * 1e6) % 1.0 + np.random.default_rng(seed).random(size)) % 1.0
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + draws), 0, top).astype(np.int64)
        lost = np.sqrt(((low[:, None] + step[:, None] * level - turned) ** 2).sum(axis=1))
        planes = np.stack([_packed(level >> p & 1) for p in range(LEVEL_BITS)], axis=1)
        return cls(_packed(turned >= 0), planes, np.stack([np.abs(turned).sum(axis=1) / math.sqrt(size), low, step, lost], axis=1), size)

    def numbers(self) -> np.ndarray:
        return np.stack([self.factor, self.low, self.step, self.lost], axis=1)

    def products(self, mine: slice, others: slice) -> np.ndarray:
        """Inner products of the normalised signs of `mine` with the rounded coordinates of `others`, by popcounts."""
        sums = np.zeros((self.signs[mine].shape[0], self.signs[others].shape[0]), np.int32)
        for w in range(self.signs.shape[1]):
            code = self.signs[mine, w][:, None]
            for p in range(self.planes.shape[1]):
                sums += np.bitwise_count(code & self.planes[others, p, w][None, :]).astype(np.int32) << p
        signed = self.low[others] * (2 * self.ones[mine, None] - self.size) + self.step[others] * (2 * sums - self.total[others])
        return signed / math.sqrt(self.size)

    def doubtful(self, mine: slice, others: slice, threshold: float, exact: bool) -> np.ndarray:
        """Pairs whose inner product may reach the threshold."""
        met, factor = self.products(mine, others), self.factor[mine, None]
        if exact:  # the angle of two vectors is at least the difference of their angles to the signs
            beyond = np.arccos(np.clip(met + self.lost[others], -1, 1)) - np.arccos(np.clip(factor, -1, 1))
            return beyond <= math.acos(threshold) + 1e-9
        spread = np.sqrt(np.maximum(0, 1 - factor**2)) + self.lost[others] / math.sqrt(self.size) * math.sqrt(max(1, self.size - 1))
        return met / factor + CONFIDENCE * spread / (factor * math.sqrt(max(1, self.size - 1))) >= threshold

    def bucket(self, number: int, bits: int, seed: int = SEED) -> np.ndarray:
        """The vectors' buckets in set `number`: some bits of their codes."""
        chosen = np.random.default_rng([seed, number]).permutation(self.size)[:bits]
        found = (self.signs[:, chosen // 64] >> (chosen % 64).astype(np.uint64)) & np.uint64(1)
        return found.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(self.signs), np.int64)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.signs[rows], self.planes[rows], self.numbers()[rows], self.size)


def plan(size: int, threshold: float = THRESHOLD, bucket: int = BUCKET, exact: bool = False) -> tuple[int, int]:
    """(sets, bits) for a label of so many distinct vectors."""
    bits = 0 if exact else max(0, math.ceil(math.log2(max(1, size) / bucket)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return (1, 0) if bits == 0 else (math.ceil(math.log(MISS) / math.log(1 - agree)), bits)


def planned(nodes: DataFrame, scratch: Scratch, threshold: float, bucket: int, exact: bool) -> DataFrame:
    """(label, dim, node, code, sets, bits) of written nodes, each label planned by its own size."""
    on, rows = ["label", "dim"], nodes.select("label", "dim", "node", "code")
    sizes = scratch.table(nodes.groupBy(*on).agg(F.count("*").alias("n")), "sizes")
    bits = F.ceil(F.log2(F.col("n") / F.lit(bucket))).cast("int")
    agree = F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.col("bits"))
    large = sizes.where(F.col("n") > bucket).withColumn("bits", bits).withColumn("sets", F.ceil(F.log(F.lit(MISS)) / F.log(1 - agree)).cast("int"))
    large = large.select(*on, "bits", "sets")
    met = rows.withColumns({"bits": F.lit(None).cast("int"), "sets": F.lit(None).cast("int")}) if exact else hot_join(rows, large, on, sizes, "left")
    return met.select(*on, "node", "code", F.coalesce("sets", F.lit(1)).alias("sets"), F.coalesce("bits", F.lit(0)).alias("bits"))


def _vectors(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


_NODE = "digest string, label string, dim int, node long, least long, weight long, v array<double>"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `code` to nodes: signs, planes and numbers of each vector as bytes."""
    for batch in slices(batches, 1024):
        dims = np.array(batch.column("dim").to_pylist())
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            c = Codes.of(_unit(_vectors(part.column("v"))))
            code = [a.tobytes() + b.tobytes() + n.tobytes() for a, b, n in zip(c.signs, c.planes, c.numbers(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.binary())], [*batch.schema.names, "code"])


def _codes(rows: list[bytes], dim: int) -> Codes:
    size = max(1, -(-CODE_BITS // dim)) * dim
    words = -(-size // 64)
    data = np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)
    return Codes(data[:, :words], data[:, words : words * (1 + LEVEL_BITS)].reshape(len(rows), LEVEL_BITS, words), data[:, words * (1 + LEVEL_BITS) :].view("<f8"), size)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, number, bucket, bits, node, code): every set's bucket of each node."""
    for batch in slices(batches, 1024):
        plans = np.array([batch.column(c).to_pylist() for c in ("dim", "sets", "bits")]).T
        for dim, sets, bits in np.unique(plans, axis=0).tolist():
            part = batch.filter(pa.array((plans == (dim, sets, bits)).all(axis=1)))
            codes = _codes(part.column("code").to_pylist(), dim)
            for t in range(sets):
                columns = [part.column("label"), part.column("dim"), pa.array(np.full(part.num_rows, t, np.int32)), pa.array(codes.bucket(t, bits)), part.column("bits"), part.column("node"), part.column("code")]
                yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "number", "bucket", "bits", "node", "code"])


#: A meeting's key; bits belongs to label and dim.
MEETING = ["label", "dim", "number", "bucket", "a", "b", "bits"]
_MEETING_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def _meetings(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows come sorted by MEETING: each meeting's key and its columns `rest`."""
    key, held = None, [[] for _ in rest]
    for batch in slices(batches, 1024):
        keys = list(zip(*(batch.column(c).to_pylist() for c in MEETING), strict=True))
        columns = [batch.column(c).to_pylist() for c in rest]
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if key is not None:
                    yield key, held
                key, held = keys[at], [[] for _ in rest]
            for h, c in zip(held, columns, strict=True):
                h += c[at:end]
            at = end
    if key is not None:
        yield key, held


def _suspects(batches: Iterator[pa.RecordBatch], threshold: float, exact: bool, step: int = 256) -> Iterator[pa.RecordBatch]:
    """(meeting, own, node) of the nodes with a pair in doubt in that meeting, judged by their codes."""
    for key, (own, node, code) in _meetings(batches, ["own", "node", "code"]):
        codes, own = _codes(code, key[1]), np.array(own)
        found = np.zeros(len(node), bool)
        for at in range(0, len(node), step):
            pairs = codes.doubtful(slice(at, at + step), slice(at, len(node)), threshold, exact)
            pairs &= np.arange(len(node) - at)[None, :] > np.arange(len(pairs))[:, None]
            if key[4] != key[5]:
                pairs &= own[at : at + step, None] != own[None, at:]
            found[at : at + step] |= pairs.any(axis=1)
            found[at:] |= pairs.any(axis=0)
        some = np.flatnonzero(found)
        columns = [pa.array([k] * len(some), t) for k, t in zip(key, _MEETING_TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(own[some], pa.int64()), pa.array([node[k] for k in some], pa.int64())], [*MEETING, "own", "node"])


def _links(batches: Iterator[pa.RecordBatch], threshold: float, step: int = 256) -> Iterator[pa.RecordBatch]:
    """(0, node, links found) and (1, node, node) of each meeting's suspects, every pair in double precision."""
    for key, (own, node, weight, code, vector) in _meetings(batches, ["own", "node", "weight", "code", "v"]):
        own, node, weight, vectors = np.array(own), np.array(node), np.array(weight, np.int64), np.array(vector, np.float64)
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        norms = np.sqrt((scaled**2).sum(axis=1))
        unit, codes = scaled / norms[:, None], _codes(code, key[1])
        links, forest, out = np.zeros(len(node), np.int64), Forest(len(node)), []
        earlier = [codes.bucket(t, key[6]) for t in range(key[2])]
        for at in range(0, len(node), step):
            i, j = np.nonzero(unit[at : at + step] @ unit[at:].T >= threshold - 1e-9)
            i, j = i + at, j + at
            ok = (i < j) & ((own[i] != own[j]) if key[4] != key[5] else True)
            for e in earlier:  # a pair belongs to the first set in which it meets
                ok &= e[i] != e[j]
            i, j = i[ok], j[ok]
            for lo in range(0, len(i), 1 << 15):
                a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                near = np.einsum("ij,ij->i", scaled[a], scaled[b]) / (norms[a] * norms[b]) >= threshold
                a, b = a[near], b[near]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                out += [(1, int(node[x]), int(node[y])) for x, y in forest.join(a, b)]
        out += [(0, int(node[k]), int(links[k])) for k in np.flatnonzero(links)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))], ["kind", "node", "value"])


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, exact: bool = False, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """Every row's id with n_links and component_id. `exact` compares every label whole, under a bound that misses nothing."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    v = F.col(quoted(vector_col)).cast("array<double>")
    label, key = F.col(quoted(label_col)), F.col(quoted(id_col)).cast("long")
    usable = F.coalesce(label.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    digest = F.sha2(F.concat_ws(",", label.cast("string"), F.transform(v, lambda x: x.cast("string"))), 256)
    rows = vectors.select(key.alias("id"), label.cast("string").alias("label"), F.when(usable, v).alias("v"), F.when(usable, digest).alias("digest"))
    # One node for each distinct vector of a label, named by its least id.
    copies = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    # numbered once, when written: ids may repeat or be null, so they cannot name vectors
    nodes = copies.select("digest", "label", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node"), "least", "weight", "v")
    nodes = scratch.table(nodes.mapInArrow(tidy(_coded), _NODE + ", code binary"), "nodes")
    keyed = planned(nodes, scratch, threshold, bucket, exact).mapInArrow(_keyed, "label string, dim int, number int, bucket long, bits int, node long, code binary")
    on = MEETING[:4]
    large = keyed.groupBy(*on).count().where(F.col("count") > 2 * chunk).select(*on, F.ceil(F.col("count") / chunk).alias("chunks"))
    large = scratch.table(large, "large")
    met = keyed.join(large, on, "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))))
    pair = F.expr("explode(transform(sequence(0L, coalesce(chunks, 1L) - 1), x -> named_struct('a', least(x, own), 'b', greatest(x, own))))")
    dealt = met.select(*on, "bits", pair.alias("p"), "own", "node", "code").select(*on, "p.a", "p.b", "bits", "own", "node", "code")
    suspects = dealt.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(tidy(lambda it: _suspects(it, threshold, exact)), "label string, dim int, number int, bucket long, a long, b long, bits int, own long, node long")
    suspects = scratch.table(suspects, "suspects")
    fetched = suspects.join(nodes.select("node", "weight", "code", "v"), "node").select(*MEETING, "own", "node", "weight", "code", "v")
    found = fetched.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(tidy(lambda it: _links(it, threshold)), "kind int, node long, value long")
    found = scratch.table(found, "found")
    links = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("found"))
    parts = connected_components(found.where("kind = 1").select("node", "value"), scratch)
    per_node = (
        nodes.select("digest", "node", "least", "weight")
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .select("digest", "least", F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
    )
    per_node = scratch.table(per_node, "per-node")
    # A component's name is the least id of its rows, whatever its nodes' numbers.
    named = scratch.table(per_node.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "names")
    answers = hot_join(per_node, named.drop("n"), ["component"], named.select("component", "n")).select("digest", "n_links", "component_id")
    alone = rows.where("digest is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = rows.where("digest is not null").select("id", "digest")
    joined = hot_join(joined, answers, ["digest"], nodes.select("digest", F.col("weight").alias("n"))).select(F.col("id").alias(id_col), "n_links", "component_id")
    return joined.union(alone)


def op9_embedding_links(spark, sf_dir: str) -> DataFrame:
    found = embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text is reduced to statistics of its bytes and words. Standardised with
the training sample's moments, they pass through random Fourier features, whose
inner products approximate a Gaussian kernel. Partitions sum their parts of the
normal equations; the sums are solved for ridge scores, and pool-adjacent
violators fit the calibration from score to probability, interpolated between
blocks so that ranks are kept.

Labels come from rows whose crc32(id as text) mod 5 is not 0; at most `SAMPLE`
of them, those with the least seeded hashes, are learnt from. Every document is
scored whole. Only the text enters a score.

Defined results: a null text counts as empty and is scored like any other text
without words. Null or repeated labels: rows with a null label are ignored, the
least of repeated ones counts. Without labels every score is 0.5. A null id is
held out of nothing: its remainder is taken as that of the empty text, which is
0, so it is marked held out and never learnt from. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, slices, tidy, utf8, without

#: Labelled rows that the model is fitted on.
SAMPLE = 20_000
FEATURES, RIDGE, SEED, THRESHOLD = 192, 1e-3, 5, 0.3
REPORT = ["held_out", "score", "predicted"]

_CLASS = np.zeros(256, np.int64)  # 0 other marks, 1 letters and bytes above ASCII, 2 digits, 3 white space, 4 common marks
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 4
_ONE = np.eye(5)[_CLASS]


def statistics(data: bytes) -> np.ndarray:
    """Of one text: sizes, shares of kinds of bytes, entropy, and how its words are built and repeated."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    kinds = counts @ _ONE / n
    share = counts[counts > 0] / n
    words = data.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = set(words)
    lines = data.split(b"\n")
    used = [x for x in lines if x]
    inner = b" ".join(words)
    return np.array([
        math.log1p(len(data)), math.log1p(len(words)), *kinds, -(share * np.log2(share)).sum(), counts[65:91].sum() / n, counts[128:].sum() / n,
        lengths.mean(), lengths.std(), (lengths <= 1).sum() / k, (lengths > 15).sum() / k, len(distinct) / k, len(distinct) / math.sqrt(k),
        1 - len(set(used)) / max(1, len(used)), len(lines) / k, share.max() if len(share) else 0.0,
        (counts[ord(".")] + counts[ord("!")] + counts[ord("?")]) / k, counts[ord(",")] / k, inner.count(b". ") / k,
        sum(map(data.count, (b"http", b"www", b"click"))) / k, math.log1p(lengths.max()),
    ])


N_STATISTICS = len(statistics(b""))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in utf8(batch.column(1))]).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "id long, x array<double>")


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


class Model:
    """Moments, random features, ridge weights and calibration; small enough to go with every task."""

    def __init__(self, dim: int, seed: int = SEED, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(dim), np.ones(dim)
        self.w = rng.standard_normal((dim, features)) / math.sqrt(dim / 2)
        self.b = rng.uniform(0, 2 * math.pi, features)
        self.weights: np.ndarray | None = None
        self.knots, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.ones((len(x), 1)), z / math.sqrt(z.shape[1]), math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are the blocks' mean scores, with the outermost scores at the ends."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    knots, values = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
    return np.concatenate([[x.min()], knots, [x.max()]]), np.concatenate([values[:1], values, values[-1:]])


def fit(sample: DataFrame, dim: int) -> Model:
    """sample: written (x, y) of labelled rows, bounded. Moments and normal equations are summed by partition."""
    model = Model(dim)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for f in frames:
            x = np.array(f["x"].tolist()).reshape(-1, dim)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x**2).sum(axis=0)
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q]})

    parts = sample.mapInPandas(moments, "n long, s array<double>, q array<double>").collect()
    n = sum(p.n for p in parts)
    if not n:
        return model
    model.mean = sum(np.array(p.s) for p in parts) / n
    model.scale = np.sqrt(np.maximum(sum(np.array(p.q) for p in parts) / n - model.mean**2, 1e-12))

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = b = 0.0
        for f in frames:
            z = model.features(np.array(f["x"].tolist()).reshape(-1, dim))
            a, b = a + z.T @ z, b + z.T @ f["y"].to_numpy(float)
        if np.ndim(a):
            yield pd.DataFrame({"a": [a.ravel()], "b": [b]})

    sums = sample.mapInPandas(equations, "a array<double>, b array<double>").collect()
    size = len(sums[0].b)
    a, b = sum(np.array(p.a).reshape(size, size) for p in sums), sum(np.array(p.b) for p in sums)
    model.weights = np.linalg.solve(a + RIDGE * n * np.eye(size) / size, b)
    rows = sample.select("x", "y").toPandas()
    model.knots, model.values = isotonic(model.raw(np.array(rows["x"].tolist()).reshape(-1, dim)), rows["y"].to_numpy(float))
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents that are not held out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null").where(~held_out("id"))
    known = hash_sample(known.groupBy("id").agg(F.min("y").alias("y")), ["id"], sample, SEED)
    # at most `sample` rows of two numbers: a proven bound for the broadcast
    met = docs.withColumn("__id", F.col(id_col).cast("long")).join(F.broadcast(known.withColumnRenamed("id", "__known")), F.col("__id") == F.col("__known"))
    x = with_statistics(met.select(F.col("__id").alias("id"), F.col(text_col).alias("text")), "id", "text")
    # the statistics run where the texts are read; only the sample's rows of numbers move
    drawn = Scratch(docs.sparkSession, "quality").table(x.join(F.broadcast(known), "id").select("x", "y").repartition(8), "sample")
    return fit(drawn, N_STATISTICS)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's id with score and predicted."""
    model = learn(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.score(np.array([statistics(t) for t in utf8(batch.column(1))]).reshape(-1, N_STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) `{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(tidy(run), f"`{id_col}` long, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with the columns of `docs`; scored in the scan, with no shuffle."""
    model = learn(docs, labels, id_col, text_col)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = [model.score(np.array([statistics(t.encode() if isinstance(t, str) else b"") for t in text[at : at + 1024]]).reshape(-1, N_STATISTICS)) for at in range(0, len(text), 1024)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(score(F.col(text_col).cast("string")) >= threshold)


def op6_fourier_quality(spark, sf_dir: str) -> DataFrame:
    docs = without(spark.read.parquet(f"{sf_dir}/documents.parquet"), REPORT)
    found = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

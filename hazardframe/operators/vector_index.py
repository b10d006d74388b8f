"""A stored index for exact vector search (K7, R4): vectors by cell, cells with centroid and radius.

Vectors lie in one partition folder a cell. No vector of a cell can score more
than query . centroid + |query| radius, and for unit vectors no more than the
cosine of the angle to the centroid less the cell's widest angle. A search looks
into each query's most promising cells first, until they hold k vectors; what the
k-th of these scores rules cells out, and only folders that some query still
needs are read again. Every answer is the one that a scan of all vectors gives.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

#: Cells at most: their centroids meet on the driver.
CELLS = 16_384


def build(vectors: DataFrame, path: str, id_col: str = "item_id", vector_col: str = "item_vec", cells: int | None = None, sample: int = 100_000, seed: int = 42) -> None:
    """Writes `vectors` by cell under `path`, and the cells' centroids, radii and sizes beside them. Centroids come from a sample of bounded size; every vector is indexed."""
    n = vectors.count()
    cells = min(CELLS, cells or max(1, math.isqrt(n)))
    v = F.col(vector_col).cast("array<double>")
    part = vectors.orderBy(F.xxhash64(F.lit(seed), id_col)).limit(sample) if n > sample else vectors
    model = KMeans(k=max(2, cells), seed=seed, maxIter=8).fit(part.select(array_to_vector(v).alias("features"))) if n > 1 else None
    centres = [c.tolist() for c in model.clusterCenters()] if model else []
    placed = model.transform(vectors.withColumn("features", array_to_vector(v))).drop("features").withColumnRenamed("prediction", "cell") if model else vectors.withColumn("cell", F.lit(0))
    placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    stored = spark.read.parquet(f"{path}/vectors")
    known = spark.createDataFrame([(k, c) for k, c in enumerate(centres)], "cell int, centroid array<double>") if centres else stored.select("cell", v.alias("centroid")).limit(1)
    known.write.mode("overwrite").parquet(f"{path}/centroids")
    met = stored.select("cell", v.alias("v")).join(F.broadcast(spark.read.parquet(f"{path}/centroids")), "cell")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.aggregate(F.zip_with("v", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    size = F.sqrt(dot("v", "v"))
    cosine = dot("v", "centroid") / (size * F.sqrt(dot("centroid", "centroid")))
    facts = met.groupBy("cell").agg(F.any_value("centroid").alias("centroid"), F.max(apart).alias("radius"), F.min(cosine).alias("narrowest"), F.max(F.abs(size - 1)).alias("off_unit"), F.count("*").alias("n"))
    facts.write.mode("overwrite").parquet(f"{path}/cells")


def _bounds(queries: np.ndarray, facts: list) -> np.ndarray:
    """What a vector of each cell can score at most with each query."""
    centres = np.array([f["centroid"] for f in facts])
    size = np.linalg.norm(queries, axis=1)
    most = queries @ centres.T + size[:, None] * np.array([f["radius"] for f in facts])
    lengths = size[:, None] * np.linalg.norm(centres, axis=1)[None, :]
    angle = np.arccos(np.clip(np.divide(queries @ centres.T, lengths, out=np.ones_like(lengths), where=lengths > 0), -1, 1))
    widest = np.arccos(np.clip([1.0 if f["narrowest"] is None else f["narrowest"] for f in facts], -1, 1))
    longest = 1 + np.array([f["off_unit"] for f in facts])
    direct = size[:, None] * longest * np.cos(np.maximum(0, angle - widest))
    return np.minimum(most, np.where(direct >= 0, direct, most)) + 1e-9


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, id_col: str = "item_id", vector_col: str = "item_vec", digits: int = 6) -> tuple[DataFrame, dict]:
    """((query_id, item_id, score, rank) as `retrieval.top_k` gives them over all vectors, and how many cells there are and were read).

    Takes as many queries as go with a task (`retrieval.QUERY_BLOCK`).
    """
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).limit(retrieval.QUERY_BLOCK + 1).collect()
    if len(asked) > retrieval.QUERY_BLOCK:
        raise ValueError(f"a search takes {retrieval.QUERY_BLOCK} queries at most")
    stored = spark.read.parquet(f"{path}/vectors").withColumnsRenamed({id_col: "item_id", vector_col: "item_vec"})
    facts = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda f: f["cell"])
    if not asked or not facts:
        return retrieval.top_k(queries, stored, k, digits), {"cells": len(facts), "read": 0}
    bounds, sizes = _bounds(np.array([q["query_vec"] for q in asked], float), facts), np.array([f["n"] for f in facts])
    order = np.argsort(-bounds, axis=1)
    enough = (np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1
    first = np.unique(np.concatenate([o[:n] for o, n in zip(order, enough, strict=True)]))
    cell = lambda chosen: stored.where(F.col("cell").isin([facts[c]["cell"] for c in chosen.tolist()]))
    found = retrieval.top_k(queries, cell(first), k, digits).where(F.col("rank") == k).select("query_id", "score")
    worst = {r["query_id"]: r["score"] for r in found.collect()}
    # scores are rounded, so a cell may still tie from half a digit below
    needed = np.array([worst.get(q["query_id"], -np.inf) for q in asked]) - 10.0**-digits
    read = np.flatnonzero((bounds >= needed[:, None]).any(axis=0))
    return retrieval.top_k(queries, cell(read), k, digits), {"cells": len(facts), "read": len(read), "rows": int(sizes[read].sum())}

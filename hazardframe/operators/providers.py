"""Seams for models that live elsewhere: embedding, language model, reranking."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Unit vectors of hashed words: deterministic, for tests and for lexical search."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


def embedded(df: DataFrame, column: str, provider: EmbeddingProvider) -> DataFrame:
    """`df` with an embedding of the text column; the provider goes to every worker once."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(provider.embed(batch.fillna("").tolist()), index=batch.index)

    return df.withColumn("embedding", run(F.col(column)))


def embedded_checked(df: DataFrame, column: str, provider: EmbeddingProvider) -> DataFrame:
    """`embedded`, in which a row without a vector of the provider's size stops the query."""
    rows = embedded(df, column, provider)
    wrong = F.coalesce(F.size("embedding") != provider.dimension, F.lit(True))
    return rows.withColumn("embedding", F.when(wrong, F.raise_error(F.lit("a row without a vector of the stated size"))).otherwise(F.col("embedding")))


def lexical_rerank(query: Column, passage: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's words that the passage has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: w != ""))
    n = F.size(words(query))
    return F.when(n > 0, F.size(F.array_intersect(words(query), words(passage))) / n).otherwise(F.lit(0.0))


class LanguageModel(Protocol):
    def extract(self, prompt: str) -> str: ...


class StubModel:
    """Answers every prompt with one text."""

    def __init__(self, answer: str = "{}"):
        self.answer, self.prompts = answer, []

    def extract(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answer


class Retrying:
    """A model whose failed calls are tried again after 1, 2, 4, .. seconds; the last failure is the caller's."""

    def __init__(self, model: LanguageModel, retries: int = 2, wait: Callable[[float], None] = time.sleep):
        self.model, self.retries, self.wait = model, retries, wait

    def extract(self, prompt: str) -> str:
        for attempt in range(self.retries + 1):
            try:
                return self.model.extract(prompt)
            except Exception:
                if attempt == self.retries:
                    raise
                self.wait(2**attempt)
        raise AssertionError


class Ladder:
    """Models in order of cost; an answer that fails its check promotes to the next, tried `retries` times each."""

    def __init__(self, models: list[tuple[str, LanguageModel]], check: Callable[[str], bool], retries: int = 1):
        self.models, self.check, self.retries = models, check, retries

    def run(self, prompt: str) -> tuple[str | None, str | None, list[str]]:
        """The model that answered, its answer, and what was tried."""
        tried: list[str] = []
        for name, model in self.models:
            for _ in range(self.retries):
                tried.append(name)
                try:
                    answer = model.extract(prompt)
                except Exception:  # a failed call counts as a failed answer
                    continue
                if self.check(answer):
                    return name, answer, tried
        return None, None, tried


REGISTRY: dict[str, Callable[..., object]] = {"hashing": HashingEmbedder, "stub": StubModel}


def provider(name: str, **options) -> object:
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**options)

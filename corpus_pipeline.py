"""From raw documents to packed token windows, in five stages of the llm operators.

Each stage gets the Spark session, what its predecessor kept, and the folder of
the input tables; `run` writes every stage's rows as Parquet in the shared
folder and hands the reread table to the next. All but the last return the
columns of documents. No stage can be said in SQL as a whole, so ORACLE_SQL is
None and the tests compare the stages with brute force.

Defined results: a null text counts as empty, in every stage. Of repeated rows,
and of all rows with one text, empty ones among them, the exact stage keeps one,
that with the largest id; a null id loses to any other and is kept as null. Near
copies leave the row with the least id. The passage stage drops rows whose text
is left empty, and sets n_chars to what is left. Ties in the passage stage are by
id; rows with a null id come last. Columns beyond those of documents pass
through, whatever their names. Empty tables go through all stages; without labels
nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import exact_dedup, packing, passages, quality, simhash
from hazardframe.llm.common import Scratch, all_of, opened, release
from hazardframe.llm.tokens import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 6)."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id (operator 10)."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike in 0.8 or more of their five-word shingles, the one with the least id (operator 4)."""
    return simhash.drop_near_duplicates(docs, similarity=0.8, width=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte passages of documents with smaller ids; documents left empty go (operator 3)."""
    left = passages.remove_passages(docs).where("text is not null and text != ''")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*all_of(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 2,048 tokens, with their ids (operator 2)."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("passage_dedup", drop_repeated_passages),
    ("packing", pack_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote for itself goes once its rows are written, and its input with it."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        mark = opened()
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        release(mark)
        if before:
            scratch.drop(before)
        before = name
    return docs

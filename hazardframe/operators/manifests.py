"""Manifests as relations: merge, upsert, resume, corpus and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a loser may lend to the winner; state is never lent.
DESCRIPTIVE = ["title", "date_occurred", "date_report_released", "detail_url", "pdf_path"]


def merge_key() -> tuple[Column, Column]:
    """Source, and address if there is one, else the id; each with a tag so the two kinds never meet."""
    url = F.nullif(F.col("pdf_url"), F.lit(""))
    return F.col("source"), F.when(url.isNotNull(), F.concat(F.lit("u:"), url)).otherwise(F.concat(F.lit("i:"), F.col("incident_id").cast("string")))


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row a key: downloaded, then newer, then with a digest, then larger, then existing wins.

    The winner takes its empty descriptive fields from the others in the same
    order. One sort by key serves both.
    """
    rows = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    source, key = merge_key()
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    order = [
        F.desc(F.coalesce("downloaded", F.lit(False))),
        F.col("retrieved_at").desc_nulls_last(),
        F.desc(filled("sha256").isNotNull()),
        F.col("file_size_bytes").desc_nulls_last(),
        F.col("__new"),
        F.col("incident_id"),
    ]
    if "row_order" in rows.columns:
        order.append(F.col("row_order"))
    w = Window.partitionBy(source, key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lent = {c: F.first(filled(c), ignorenulls=True).over(whole) for c in DESCRIPTIVE if c in rows.columns}
    return rows.withColumns({"__n": F.row_number().over(w), **{f"__{c}": x for c, x in lent.items()}}).where("__n = 1").withColumns({c: F.col(f"__{c}") for c in lent}).select(*existing.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace existing ones of their key; among new ones the last by row_order."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc("row_order"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*existing.columns)


def pending(candidates: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Candidates that are not processed yet; all of them with `force`."""
    return candidates if force else candidates.join(done.select(key), key, "left_anti")


def corpus(pdfs: DataFrame, structured: DataFrame, flagged: DataFrame) -> DataFrame:
    """(stem, status, flagged): whether each document has its structured form, and is in `flagged`."""
    met = pdfs.select("stem").distinct().join(structured.select("stem").distinct().withColumn("__s", F.lit(True)), "stem", "left")
    met = met.join(flagged.select("stem").distinct().withColumn("__f", F.lit(True)), "stem", "left")
    return met.select("stem", F.when(F.col("__s"), "ready").otherwise("needs_extraction").alias("status"), F.coalesce("__f", F.lit(False)).alias("flagged"))


def noise(structured: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Structured forms without a document, to be set aside."""
    return structured.select("stem").distinct().join(pdfs.select("stem"), "stem", "left_anti")

"""Sinks: CSV with headers, manifests, reports, address lists."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """Fixed column order; the header is written even without rows. `single` is for reports of few rows."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").option("quoteAll", "false").option("escape", '"').option("emptyValue", "").csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Nulls as blanks, booleans as True and False, so text readers take it back."""

    def cell(name: str, kind: str):
        text = F.initcap(F.col(name).cast("string")) if kind == "boolean" else F.col(name).cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    write_csv(df.select(*[cell(n, k) for n, k in df.dtypes]), path)


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def report(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A small result as plain values; more rows than `most` is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in rows]


def markdown(df: DataFrame, title: str) -> str:
    rows, names = report(df), df.columns
    return "\n".join([f"## {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *[f"| {' | '.join(str(r.get(n)) for n in names)} |" for r in rows]])


def write_url_lists(candidates: DataFrame, folder: str) -> None:
    """Two tables: (doc_id, url), and (doc_id, title, date, page_url, url, source)."""
    write_csv(candidates, f"{folder}/url_list", ["doc_id", "url"])
    write_csv(candidates, f"{folder}/metadata", ["doc_id", "title", "date", "page_url", "url", "source"])


def write_raw(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Raw payloads for audit as rows (id, value) of JSON lines, in as many files as there are partitions."""
    df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("value")).write.mode("overwrite").json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, value string").json(path)


def markdown_report(title: str, sections: dict[str, DataFrame | dict]) -> str:
    """A report of several small tables or lists of facts under one title."""
    parts = [f"# {title}"]
    for name, content in sections.items():
        if isinstance(content, dict):
            parts.append("\n".join([f"## {name}", "", *[f"- {k}: {v}" for k, v in content.items()]]))
        else:
            parts.append(markdown(content, name))
    return "\n\n".join(parts) + "\n"


def _fold_lines(aucs: list[float | None], floor: float | None = None) -> list[str]:
    said = lambda a: "undefined" if a is None else f"{a:.4f}{' (below the floor)' if floor is not None and a < floor else ''}"
    return ["| Fold | AUC |", "|-|-|", *[f"| {k} | {said(a)} |" for k, a in enumerate(aucs, 1)]]


def cv_report(models: dict[str, dict]) -> str:
    """Cross-validation of each target, from the metadata of `ml.train_cascade`."""
    parts = ["# Cross-validation"]
    for target, meta in models.items():
        scores = meta["cv_scores"]
        mean = "undefined" if scores["mean"] is None else f"{scores['mean']:.4f} ± {scores['std']:.4f}"
        facts = [f"- training rows: {meta['training_rows']}", f"- share of positives: {meta['positive_rate'] or 0:.4f}"]
        parts.append("\n".join([f"## {target}", "", *facts, "", *_fold_lines(scores["per_fold"]), "", f"Mean AUC: {mean}"]))
    return "\n\n".join(parts) + "\n"


def gate_report(aucs: list[float | None], mean: float = 0.70, floor: float = 0.60) -> tuple[str, bool]:
    """The gate's report and verdict: the mean and every fold must reach their limits; an undefined fold fails."""
    known = [a for a in aucs if a is not None]
    average = sum(known) / len(known) if known else 0.0
    spread = (sum((a - average) ** 2 for a in known) / len(known)) ** 0.5 if known else 0.0
    passed = bool(known) and len(known) == len(aucs) and average >= mean and min(known) >= floor
    lines = ["# Gate", "", f"Limits: mean AUC {mean}, each fold {floor}", "", *_fold_lines(aucs, floor), "", f"Mean AUC: {average:.4f} ± {spread:.4f}", "", f"Verdict: {'PASS' if passed else 'FAIL'}"]
    return "\n".join(lines) + "\n", passed


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small text file through Spark, so any store will do; its folder holds one part."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()["value"]


def write_thresholds(spark: SparkSession, thresholds: DataFrame, path: str) -> dict:
    """The one row of thresholds as JSON, keys in order; returns it."""
    values = report(thresholds)[0]
    write_text(spark, path, json.dumps(values, indent=2, sort_keys=True))
    return values


def summary(counts: DataFrame, name: str, n: str = "n") -> list[str]:
    """Lines for a console, most frequent first."""
    rows = sorted(report(counts), key=lambda r: (-r[n], str(r[name])))
    return [f"{r[name]}: {r[n]}" for r in rows]


def save_model(model: PipelineModel | boosting.BoostedTrees, path: str, metadata: dict | None = None, background: DataFrame | None = None) -> None:
    """The model (trees as a JSON file, others as Spark does), its metadata as JSON, and the rows its explanations start from."""
    spark = SparkSession.getActiveSession()
    trees = isinstance(model, boosting.BoostedTrees)
    if trees:
        boosting.write_boosted(spark, model, f"{path}/trees")
    else:
        model.write().overwrite().save(f"{path}/model")
    write_text(spark, f"{path}/metadata", json.dumps({"model_format": "trees" if trees else "pipeline", **(metadata or {})}, sort_keys=True))
    if background is not None:
        background.write.mode("overwrite").parquet(f"{path}/background")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | boosting.BoostedTrees, dict]:
    metadata = json.loads(read_text(spark, f"{path}/metadata"))
    trees = metadata.pop("model_format", "pipeline") == "trees"
    return boosting.read_boosted(spark, f"{path}/trees") if trees else PipelineModel.load(f"{path}/model"), metadata


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of every file of an artifact."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+(?:/[^/]+)?)$", 1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

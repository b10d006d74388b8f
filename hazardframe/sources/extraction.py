"""Structured forms from texts by a ladder of language models, resumable by what is written."""

from __future__ import annotations

import json
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import manifests, providers

PROMPT = "Extract the incident as JSON.\n{{text}}"
RESULT = "stem string, model string, json string, tried array<string>, truncated boolean, outcome string"


def parsed(answer: str | None) -> dict | None:
    """The JSON object that an answer is, or that its first fence or outermost braces hold."""
    if not answer:
        return None
    fenced = answer.split("```")
    tries = [answer, *([fenced[1].removeprefix("json")] if len(fenced) > 2 else []), answer[answer.find("{") : answer.rfind("}") + 1]]
    for part in tries:
        try:
            found = json.loads(part)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def pending(rows: DataFrame, texts: DataFrame, done: DataFrame, limit: int = 50_000, template: str = PROMPT) -> DataFrame:
    """(stem, prompt) of the rows that need a form and have none yet; prompt is null where no text is there. limit: characters of a text, 0 for all."""
    needed = rows.where("status = 'needs_extraction'").select("stem").distinct()
    body = text.truncated(F.col("text"), limit) if limit else F.col("text")
    met = manifests.pending(needed, done.where("outcome = 'ok'"), "stem").join(texts.groupBy("stem").agg(F.min("text").alias("text")), "stem", "left")
    return met.select("stem", F.when(F.col("text").isNotNull(), text.fill_template(template, text=body)).alias("prompt"))


def run(spark: SparkSession, rows: DataFrame, texts: DataFrame, models: list[tuple[str, providers.LanguageModel]], folder: str, delay: float = 30.0, limit: int = 50_000, retries: int = 1, tasks: int = 1) -> DataFrame:
    """Extracts what is pending and returns every outcome so far: ok, no text, or failed on all models.

    Results lie in one folder a run under `folder`; a row that failed is tried
    again by the next run, one that succeeded is not. `tasks` tasks call at the same
    time, each waiting `delay` seconds after a call that succeeded.
    """
    ladder = providers.Ladder(models, lambda answer: parsed(answer) is not None, retries)

    def extract(frames):
        for frame in frames:
            out = []
            for stem, prompt in zip(frame["stem"], frame["prompt"], strict=True):
                if prompt is None:
                    out.append((stem, None, None, [], None, "no text"))
                    continue
                name, answer, tried = ladder.run(prompt)
                model = dict(models).get(name)
                cut = (getattr(model, "last_meta", None) or {}).get("stop_reason") == "max_tokens" if name else None
                out.append((stem, name, json.dumps(parsed(answer), sort_keys=True) if name else None, tried, cut, "ok" if name else "failed"))
                if name and delay:
                    time.sleep(delay)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    done = outcomes(spark, folder)
    number = done.agg(F.coalesce(F.max("run"), F.lit(-1))).head()[0] + 1
    todo = pending(rows, texts, done, limit)
    todo.repartition(tasks, "stem").mapInPandas(extract, RESULT).write.mode("overwrite").parquet(f"{folder}/extracted/run={number}")
    return latest(outcomes(spark, folder))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What every run gave, with its number."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/extracted")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], RESULT + ", run int")
    return spark.read.schema(RESULT + ", run int").parquet(f"{folder}/extracted")


def latest(found: DataFrame) -> DataFrame:
    """The newest outcome of each stem, a success before any other."""
    best = F.max_by(F.struct(*found.columns), F.struct((F.col("outcome") == "ok").cast("int"), "run"))
    return found.groupBy("stem").agg(best.alias("r")).select("r.*")

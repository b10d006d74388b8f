"""Incident JSON files as rows, flat incidents and flat controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..functions.vocabulary import FACTORS
from ..operators.coercion import list_of, parse, text_of
from ..operators.taxonomy import source_agency
from ..schemas import INCIDENT


def read_json(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(json_path, incident_id, payload, v): every .json file, one row each, in no order.

    A byte order mark is dropped; a file that is not JSON has a null v and is
    counted by the caller, not lost. The id defaults to the file's stem.
    """
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "[!.]*.json").text(folder, wholetext=True)
    rows = parse(files.select(F.col("_metadata.file_path").alias("json_path"), F.col("value").alias("payload")))
    stem = file_stem(F.col("json_path"))
    return rows.withColumn("incident_id", F.coalesce(F.nullif(F.try_variant_get("v", "$.incident_id", "string"), F.lit("")), stem))


def aggregated(parsed: DataFrame) -> DataFrame:
    """(incident_id, source_file, payload) of every document that is an object, in the order of paths; a source_file of its own stays."""
    own = F.nullif(F.try_variant_get("v", "$.source_file", "string"), F.lit(""))
    rows = parsed.where("v is not null").where(F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select("incident_id", F.coalesce(own, "json_path").alias("source_file"), "payload").orderBy("source_file")


def typed(parsed: DataFrame) -> DataFrame:
    """The documents in the fixed schema; fields of another type are null."""
    return parsed.where("v is not null").select("json_path", F.from_json(F.regexp_replace("payload", r"^\x{FEFF}", ""), INCIDENT).alias("d")).select("json_path", "d.*")


def flat_incidents(parsed: DataFrame) -> DataFrame:
    """One wide row a readable document: incident__<section>__<field>, missing scalars blank, factor flags false."""
    v = F.col("v")
    blank = lambda path: F.coalesce(text_of(v, path), F.lit("")).alias("incident__" + path[2:].replace(".", "__"))
    fields = ["source.doc_type", "source.url", "source.title", "source.date_published", "source.date_occurred", "context.region", "context.operator", "context.operating_phase", "event.top_event", "event.incident_type", "event.costs", "event.summary"]
    flags = [(c, f) for c, names in FACTORS.items() for f in names]
    told = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.source.{k}", "string"), F.lit("")) for k in names], F.lit(""))  # noqa: E731  the first that is not blank
    return parsed.where("v is not null").select(
        "incident_id",
        source_agency(told("agency", "publisher", "report_source"), told("doc_type", "document_type"), told("url", "document_url"), F.col("json_path")).alias("source_agency"),
        F.element_at(F.split("json_path", "/"), -2).alias("provider_bucket"),
        *[blank(f"$.{p}") for p in fields],
        F.array_join(list_of(v, "$.context.materials"), ", ").alias("incident__context__materials"),
        *[x for c, f in flags for x in (blank(f"$.pifs.{c}.{f}_value"), F.coalesce(F.try_variant_get("v", f"$.pifs.{c}.{f}_mentioned", "boolean"), F.lit(False)).alias(f"incident__pifs__{c}__{f}_mentioned"))],
        "json_path",
    )


def flat_controls(parsed: DataFrame) -> DataFrame:
    """One row a control; documents without controls give none, entries that are not objects are skipped."""
    controls = F.coalesce(F.try_variant_get("v", "$.bowtie.controls", "array<variant>"), F.try_variant_get("v", "$.controls", "array<variant>"))
    rows = parsed.where("v is not null").select("incident_id", "json_path", F.posexplode(controls).alias("control_seq", "c")).where(F.schema_of_variant("c").startswith("OBJECT"))
    c = F.col("c")
    text = lambda path, name: F.coalesce(F.try_variant_get(c, path, "string"), F.lit("")).alias(name)
    flag = lambda path, name: F.coalesce(F.try_variant_get(c, path, "boolean"), F.lit(False)).alias(name)
    return rows.select(
        "incident_id",
        "control_seq",
        *[text(f"$.{n}", n) for n in ("control_id", "name", "side", "barrier_role", "barrier_type", "line_of_defense", "lod_basis")],
        *[F.array_join(list_of(c, f"$.{n}"), ",").alias(n) for n in ("linked_threat_ids", "linked_consequence_ids")],
        text("$.performance.barrier_status", "barrier_status"),
        flag("$.performance.barrier_failed", "barrier_failed"),
        text("$.human.human_contribution_value", "human_contribution_value"),
        flag("$.human.barrier_failed_human", "barrier_failed_human"),
        text("$.evidence.confidence", "confidence"),
        F.size(list_of(c, "$.evidence.supporting_text")).alias("supporting_text_count"),
        "json_path",
    )

"""Manifests, text, address lists, bulk tables and local documents."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pdf import pdf_text
from ..functions.text import file_stem, parse_date, slug


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With a schema, typed; without, all text. No pass over the data to infer types."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A text manifest in its types: blanks are null, true in any case is true, what cannot be read is null."""
    rows = read_csv(spark, path)

    def cell(f: T.StructField) -> Column:
        if f.name not in rows.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        raw = F.nullif(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, T.BooleanType):
            return (F.lower(F.trim(F.coalesce(raw, F.lit("")))) == "true").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.try_to_timestamp(raw).alias(f.name)
        return raw.try_cast(f.dataType).alias(f.name)

    return rows.select(*[cell(f) for f in schema.fields])


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, text): every .txt file below the folder, whole."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), file_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))


def first_text(spark: SparkSession, stems: DataFrame, folders: list[str]) -> DataFrame:
    """The text of each stem from the first folder that has it, null if none does."""
    found = None
    for rank, folder in enumerate(folders):
        here = read_texts(spark, folder).select("stem", F.lit(rank).alias("rank"), "text")
        found = here if found is None else found.unionByName(here)
    best = found.groupBy("stem").agg(F.min_by("text", "rank").alias("text"))
    return stems.join(best, "stem", "left")


def text_blocks(texts: DataFrame, column: str = "text") -> DataFrame:
    """Incidents of key: value blocks that blank lines part; lines that do not begin a key continue the one before.

    A block needs an ID and a description. Dates that cannot be read are null;
    Causes, consequences and barriers are lists parted by commas.
    """
    blocks = texts.select(F.explode(F.split(F.regexp_replace(column, r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("block"))
    joined = F.regexp_replace("block", r"\n(?![A-Za-z][\w ]*:)", " ")
    value = lambda key: F.nullif(F.trim(F.regexp_extract(joined, rf"(?im)^{key}[ \t]*:[ \t]*(.*)$", 1)), F.lit(""))
    items = lambda key: F.filter(F.transform(F.split(F.coalesce(value(key), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select(
        value("ID").alias("incident_id"),
        parse_date(value("Date")).alias("date_occurred"),
        value("Facility").alias("facility"),
        value("Description").alias("description"),
        items("Causes").alias("causes"),
        items("Consequences").alias("consequences"),
        items("Prevention Barriers").alias("prevention_barriers"),
        items("Mitigation Barriers").alias("mitigation_barriers"),
    )
    return rows.where("incident_id is not null and description is not null")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url): rows without an address are skipped; the id defaults to the address's stem."""
    rows = read_csv(spark, path)
    url = F.trim(F.coalesce("url", F.lit("")))
    stem = F.regexp_extract(F.regexp_replace(url, r"[?#].*", ""), r"([^/]*?)(?:\.[^./]*)?/*$", 1)
    given = F.nullif(F.trim(F.col("doc_id")), F.lit("")) if "doc_id" in rows.columns else F.lit(None).cast("string")
    return rows.where(url != "").select(F.coalesce(given, stem).alias("doc_id"), url.alias("url"))


# Headers that mean the same in bulk tables, in the order they are tried, and the page the tables come from.
ALIASES = {
    "id": ["report_number", "report number", "reportnumber", "id"],
    "date": ["incident_date", "incident date", "date", "iyear"],
    "narrative": ["narrative", "description", "summary"],
    "city": ["city", "location_city"],
    "state": ["state", "location_state"],
    "operator": ["operator_name", "operator"],
    "commodity": ["commodity_released_type", "commodity"],
    "volume": ["unintentional_release_bbls", "net_loss_barrels", "total_release_volume"],
}
BULK_PAGE = "https://www.phmsa.dot.gov/data-and-statistics/pipeline/data-and-statistics-overview"
BULK_MANIFEST = ["doc_id", "incident_id", "json_path", "valid", "provider", "error", "created_at"]


def resolve_headers(columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """The column of each field by the first alias that is there, whatever its case."""
    have = {c.strip().lower(): c for c in columns}
    return {field: have[a] for field, names in aliases.items() for a in [next((n for n in names if n in have), None)] if a}


def numbered(rows: DataFrame, name: str = "n") -> DataFrame:
    """Rows with their place in the file, from 0, without a gap: places in partitions plus the sizes of those before.

    One row for each partition enters the running sum. The order is that of a
    scan, which is the same each time.
    """
    placed = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__m"))
    before = F.coalesce(F.sum("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = placed.join(F.broadcast(sizes.select("__part", before.alias("__base"))), "__part")
    return met.withColumn(name, F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__base")


def placed(rows: DataFrame, path: str, name: str = "n") -> DataFrame:
    """Sorted rows with their place, from 0: written under `path` with their place in their partition, and the sizes of the partitions before added."""
    rows.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    stored = rows.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    sizes = stored.groupBy("__part").agg(F.count("*").alias("__m"))
    before = F.coalesce(F.sum("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = stored.join(F.broadcast(sizes.select("__part", before.alias("__base"))), "__part")  # one row a partition
    return met.withColumn(name, F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__base")


def ordered(rows: DataFrame, by: list[str], path: str, name: str = "n") -> DataFrame:
    """Rows with their place in the order of `by`, from 0."""
    return placed(rows.repartitionByRange(*by).sortWithinPartitions(*by), path, name)


def bulk_candidates(rows: DataFrame, prefix: str = "phmsa", limit: int | None = None) -> DataFrame:
    """(doc_id, url, title, date, page_url, source) of a bulk table, row by row; ids are slugs of report ids, else the row's number.

    `limit` takes the first rows of the file.
    """
    found = resolve_headers(rows.columns)
    get = lambda f: F.trim(F.coalesce(F.col(f"`{found[f]}`").cast("string"), F.lit(""))) if f in found else F.lit("")
    placed = numbered(rows)
    placed = placed.where(F.col("n") < limit) if limit is not None else placed
    report = F.coalesce(F.nullif(get("id"), F.lit("")), F.format_string(f"{prefix}-%05d", "n"))
    title = F.coalesce(F.nullif(F.substring(get("narrative"), 1, 200), F.lit("")), F.concat(F.lit(f"{prefix.upper()} incident "), report))
    return placed.select(slug(report, 80).alias("doc_id"), F.lit("").alias("url"), title.alias("title"), get("date").alias("date"), F.lit(BULK_PAGE).alias("page_url"), F.lit(prefix).alias("source"))


def inspect_bulk(spark: SparkSession, path: str, limit: int | None = None) -> dict:
    """What a bulk table holds: the fields recognised, those missing, and its rows (0 where an id or a narrative is missing)."""
    try:
        rows = read_csv(spark, path)
    except Exception as e:  # a missing or unreadable table is an answer, not a failure
        return {"recognised": {}, "missing": sorted(ALIASES), "rows": 0, "error": type(e).__name__}
    found = resolve_headers(rows.columns)
    usable = "id" in found and "narrative" in found
    return {"recognised": found, "missing": sorted(set(ALIASES) - set(found)), "rows": (rows.limit(limit) if limit else rows).count() if usable else 0, "error": None}


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, stem, size, sha256) of local files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", file_stem(F.col("path")).alias("stem"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def extract_text(files: DataFrame, extractors: list[tuple[str, Callable[[bytes], str]]]) -> DataFrame:
    """(path, extractor_used, text, page_count, fail_reason): the first extractor that gives text, its pages joined by a blank line.

    Extractors are functions from bytes to text with a form feed between pages;
    callers may bring their own beside `EXTRACTORS`. Files are handled one at a time.
    """

    def run(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                reason = "no extractor"
                for name, extract in extractors:
                    try:
                        text = extract(bytes(content))
                    except Exception as e:  # one extractor's failure hands on to the next
                        reason = f"{name}: {type(e).__name__}"
                        continue
                    if text.strip():
                        pages = text.split("\f")
                        out.append((path, name, "\n\n".join(p.rstrip() for p in pages), len(pages), None))
                        break
                    reason = f"{name}: empty"
                else:
                    out.append((path, None, "", 0, reason))
            yield pd.DataFrame(out, columns=["path", "extractor_used", "text", "page_count", "fail_reason"])

    return files.select("path", "content").mapInPandas(run, "path string, extractor_used string, text string, page_count int, fail_reason string")


def fallback_text(files: DataFrame, bundled: dict[str, Callable[[bytes], str]], order: list[str]) -> DataFrame:
    """`extract_text` by extractors of a registry, tried in the order of their names."""
    if unknown := [n for n in order if n not in bundled]:
        raise ValueError(f"unknown extractors {unknown}; known: {sorted(bundled)}")
    return extract_text(files, [(n, bundled[n]) for n in order])


def plain_text(content: bytes) -> str:
    """Text in UTF-8; anything else, and a PDF that happens to be readable, is an error, so the next extractor is tried."""
    if content[:1024].find(b"%PDF-") >= 0:
        raise ValueError("a PDF")
    return content.decode("utf-8-sig")


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_text, "text": plain_text}


def ingest_documents(spark: SparkSession, folder: str, target: str, source: str = "local", pattern: str = "*.pdf") -> DataFrame:
    """Copies local documents into a table under `target` (path, sha256, content) and returns their manifest rows.

    The copies are rows of few files, so any store will do and no folder fills
    with small files. A document of equal content is copied once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = files.select("path", file_stem(F.col("path")).alias("stem"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    first = rows.groupBy("sha256").agg(F.min("path").alias("path"))
    rows.join(first, ["sha256", "path"]).select("path", "sha256", "content").write.mode("overwrite").parquet(target)
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.lit(source).alias("source"), F.col("stem").alias("incident_id"), F.col("stem").alias("title"), none("string").alias("date_occurred"), none("string").alias("date_report_released"), F.lit("").alias("detail_url"), F.lit("").alias("pdf_url"),
        F.col("path").alias("pdf_path"), F.lit(True).alias("downloaded"), none("timestamp").alias("retrieved_at"), none("int").alias("http_status"), F.lit("application/pdf").alias("content_type"), F.col("size").alias("file_size_bytes"), "sha256", none("string").alias("error"),
    )


def whole_text(spark: SparkSession, path: str) -> str:
    """A small text file, or the one part of a folder, from any store."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration file; YAML needs its library."""
    content = whole_text(spark, path)
    if not path.endswith((".yaml", ".yml")):
        return json.loads(content)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: YAML files need PyYAML") from e
    return yaml.safe_load(content) or {}


def read_config(spark: SparkSession, mapping: dict | str, section: str | None = None, field: str = "display_name") -> DataFrame:
    """A configuration mapping, or a section of a configuration file, as the small table (raw, display); entries may be texts or objects with `field`."""
    table = load_config(spark, mapping) if isinstance(mapping, str) else mapping
    table = table.get(section, {}) if section else table
    rows = [(str(k), str(v[field] if isinstance(v, dict) else v)) for k, v in table.items()]
    return spark.createDataFrame(rows, "raw string, display string")


# The metrics of a fleet that was never processed.
NO_METRICS = {"total_incidents": 0, "average_prevention_coverage": 0.0, "average_mitigation_coverage": 0.0, "average_overall_coverage": 0.0}


def read_processed(spark: SparkSession, folder: str) -> tuple[DataFrame | None, dict]:
    """Processed incidents of an older layout (INC-*.json, by id) and the metrics beside them; none, and zeros, where they are missing."""
    try:
        rows = spark.read.option("multiLine", "true").option("pathGlobFilter", "INC-*.json").json(folder)
        incidents = rows.orderBy("incident_id") if "incident_id" in rows.columns else None
    except Exception:  # no such folder
        return None, dict(NO_METRICS)
    try:
        return incidents, json.loads(whole_text(spark, f"{folder}/fleet_metrics.json"))
    except (AnalysisException, ValueError):  # no such file, or no JSON
        return incidents, dict(NO_METRICS)


def read_bowtie(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, name, side) of the reference barriers of a bowtie file; None if it is missing or cannot be read."""
    try:
        barriers = json.loads(whole_text(spark, path))["barriers"]
        rows = [(str(b.get("id", "")), str(b["name"]), str(b["type"])) for b in barriers]
    except (AnalysisException, ValueError, KeyError, TypeError):
        return None
    return spark.createDataFrame(rows, "id string, name string, side string")

"""Queries over what is written and read back: manifests, address lists, raw copies, JSON files, and streams into tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_folder
from ..sources import files, incidents, sinks
from ..streaming import manifests as streams
from .registry import query, table
from .scenarios import _MANIFEST, _manifest

_FIELDS = ["source", "incident_id", "pdf_url", "downloaded", "retrieved_at", "sha256", "file_size_bytes", "title", "pdf_path", "row_order"]


def _merged(rows: str, new: str) -> str:
    """Of each key the best row; it takes an empty title or path from the next that has one. new: what says that a row is of the newer side."""
    return f"""SELECT source, w.incident_id, w.pdf_url, w.downloaded, w.retrieved_at, w.sha256, w.file_size_bytes, title, pdf_path, w.row_order FROM (
      SELECT source, arg_min(struct_pack(incident_id, pdf_url, downloaded, retrieved_at, sha256, file_size_bytes, row_order), n) AS w, arg_min(title, n) FILTER (title <> '') AS title, arg_min(pdf_path, n) FILTER (pdf_path IS NOT NULL) AS pdf_path FROM (
        SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY downloaded DESC, retrieved_at DESC NULLS LAST, (sha256 <> '') DESC, file_size_bytes DESC NULLS LAST, {new}, incident_id, row_order) AS n
        FROM (SELECT *, CASE WHEN pdf_url <> '' THEN 'u:' || pdf_url ELSE 'i:' || incident_id END AS key FROM {rows})) GROUP BY source, key)"""


def _arriving(spark, sf, run):
    """Runs a stream over the older half of the events' manifest, then again once the newer half has arrived."""
    path, (older, newer) = work_folder(spark, "stream"), _manifest(spark, sf)
    for k, part in enumerate((older, newer)):
        part.select(*_FIELDS).write.parquet(f"{path}/in/{k}")
        run(f"{path}/in/*", T.StructType(part.select(*_FIELDS).schema.fields), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return path


@query(
    "streamed_merge",
    "SELECT source, incident_id, pdf_url, downloaded, epoch_us(retrieved_at) AS retrieved_us, sha256, file_size_bytes, title, pdf_path, row_order FROM newest",
    _MANIFEST,
    f"oldest AS (SELECT *, 0 AS side FROM ({_merged('(SELECT * FROM m WHERE row_order % 2 = 0)', '0')}) UNION ALL SELECT {', '.join(_FIELDS)}, 1 FROM m WHERE row_order % 2 = 1)",
    f"newest AS ({_merged('oldest', 'side')})",
)
def streamed_merge(spark, sf):
    path = _arriving(spark, sf, lambda *where: streams.merge_stream(spark, *where))
    stored = streams.merged_table(spark, f"{path}/table", _manifest(spark, sf)[0].select(*_FIELDS).schema).read()
    return stored.select(*[c for c in _FIELDS[:4]], F.unix_micros(F.col("retrieved_at").cast("timestamp")).alias("retrieved_us"), *_FIELDS[5:])


@query("streamed_upsert", "SELECT incident_id, title, row_order FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY row_order % 2 DESC, row_order DESC) AS n FROM m) WHERE n = 1", _MANIFEST)
def streamed_upsert(spark, sf):
    path = _arriving(spark, sf, lambda *where: streams.upsert_stream(spark, *where, "incident_id"))
    stored = streams.upserted_table(spark, f"{path}/table", _manifest(spark, sf)[0].select(*_FIELDS).schema, "incident_id").read()
    return stored.select("incident_id", "title", "row_order")


@query("first_seen_users", "SELECT DISTINCT user_id FROM events")
def first_seen_users(spark, sf):
    """Each user once, from a stream that remembers whom it has seen."""
    path, events = work_folder(spark, "seen"), table(spark, sf, "events").select("user_id", "event_type")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    streams.first_seen(stream, "user_id").writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/seen").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{path}/seen").select("user_id")


@query("manifest_round_trip", "SELECT row_order, source, incident_id, nullif(pdf_url, '') AS pdf_url, coalesce(downloaded, false) AS downloaded, epoch_us(retrieved_at) AS retrieved_us, nullif(sha256, '') AS sha256, file_size_bytes, nullif(title, '') AS title, pdf_path FROM m", _MANIFEST)
def manifest_round_trip(spark, sf):
    """A manifest as text and back in its types."""
    path, (a, b) = work_folder(spark, "manifest"), _manifest(spark, sf)
    rows = a.unionByName(b).withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    sinks.write_manifest(rows, path)
    back = files.read_manifest(spark, path, rows.schema)
    return back.select("row_order", "source", "incident_id", "pdf_url", "downloaded", F.unix_micros("retrieved_at").alias("retrieved_us"), "sha256", "file_size_bytes", "title", "pdf_path")


@query("raw_copies", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS value FROM documents")
def raw_copies(spark, sf):
    """Texts as they came, with line breaks and marks, in rows of JSON."""
    path = work_folder(spark, "raw")
    sinks.write_raw(table(spark, sf, "documents"), path, "doc_id", "text")
    return sinks.read_raw(spark, path)


@query("address_lists", "SELECT CASE WHEN page_id % 3 = 0 THEN regexp_extract(regexp_replace(trim(url), '[?#].*', ''), '([^/]*?)(?:\\.[^./]*)?/*$', 1) ELSE 'p' || page_id END AS doc_id, trim(url) AS url FROM pages WHERE coalesce(trim(url), '') <> '' AND page_id % 5 <> 0")
def address_lists(spark, sf):
    """Candidates as lists of addresses and back; those without an address are left out, those without an id get one from it."""
    path, k = work_folder(spark, "addresses"), F.col("page_id")
    none = lambda n: F.lit("").alias(n)
    rows = table(spark, sf, "pages").select(F.when(k % 3 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("doc_id"), F.when(k % 5 != 0, F.concat(F.lit(" "), "url", F.lit(" "))).alias("url"), none("title"), none("date"), none("page_url"), none("source"))
    sinks.write_url_lists(rows, path)
    return files.read_url_list(spark, f"{path}/url_list")


@query(
    "json_files",
    """SELECT 'N-' || s_nationkey AS incident_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS control_seq, 'C-' || s_suppkey AS control_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'prevention' ELSE 'mitigation' END AS side FROM supplier""",
)
def json_files(spark, sf):
    """One JSON file a nation, its suppliers as controls, read back as flat controls; a file that is no JSON is passed over."""
    path, k = work_folder(spark, "json"), F.col("s_suppkey")
    control = F.struct(k.alias("__k"), F.concat(F.lit("C-"), k.cast("string")).alias("control_id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "prevention").otherwise("mitigation").alias("side"))
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(control)).alias("controls"))
    docs = rows.select(F.col("s_nationkey").alias("n"), F.concat(F.lit("N-"), F.col("s_nationkey").cast("string")).alias("incident_id"), F.struct(F.transform("controls", lambda c: c.dropFields("__k")).alias("controls")).alias("bowtie"))
    docs.repartition("n").write.partitionBy("n").json(path)
    parsed = incidents.read_json(spark, path)
    return incidents.flat_controls(parsed).select("incident_id", F.col("control_seq").cast("long").alias("control_seq"), "control_id", "name", "side")

"""Connectors to publishers' pages: a transport from the caller, fetching in tasks, and an adapter for each publisher.

Nothing here opens a connection by itself: a transport is any picklable object
with get(url), so tests and offline runs hand one in. Pages go through the same
link operators as stored ones.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions import html, text
from ..session import work_folder
from .crawl import FRONTIER, crawl

#: Bytes of a document that one row may carry; larger ones are an error of that row.
MOST_BYTES = 512 << 20


class Transport(Protocol):
    def get(self, url: str) -> tuple[int, str, bytes]:
        """Status, content type and body."""
        ...


@dataclass
class Pages:
    """A transport over stored pages, for tests and offline runs: {url: body}."""

    bodies: dict[str, bytes]

    def get(self, url: str) -> tuple[int, str, bytes]:
        if url not in self.bodies:
            return 404, "text/plain", b""
        return 200, "application/pdf" if url.lower().endswith(".pdf") else "text/html", self.bodies[url]


@dataclass
class Stored:
    """Pages of a table (url, content), which `fetch` joins: nothing of it goes through the driver."""

    table: DataFrame

    def fetched(self, urls: DataFrame) -> DataFrame:
        kind = F.when(F.lower("url").endswith(".pdf"), "application/pdf").otherwise("text/html")
        large = F.octet_length("content") > MOST_BYTES
        rows = urls.join(self.table.select("url", "content"), "url", "left").dropDuplicates(["url"])
        return rows.select(
            "url", F.when(F.col("content").isNull(), 404).otherwise(200).cast("int").alias("http_status"), F.when(F.col("content").isNull(), "text/plain").otherwise(kind).alias("content_type"),
            F.when(~large, F.col("content")).alias("content"), F.octet_length("content").cast("long").alias("file_size_bytes"), F.when(~large, F.sha2("content", 256)).alias("sha256"),
            F.when(F.col("content").isNull(), "HTTP 404").when(large, "too large").alias("error"), F.current_timestamp().alias("retrieved_at"),
        )

    @classmethod
    def folder(cls, spark: SparkSession, path: str) -> Stored:
        """Files whose names are the quoted addresses."""
        files = spark.read.format("binaryFile").load(path)
        return cls(files.select(text.unquote(F.element_at(F.split("path", "/"), -1)).alias("url"), "content"))


_FETCHED = "url string, http_status int, content_type string, content binary, file_size_bytes long, sha256 string, error string, retrieved_at timestamp"


def fetch(urls: DataFrame, transport: Transport | Stored, pause: float = 0.0, tries: int = 1, column: str = "url") -> DataFrame:
    """One row for each distinct address: status, type, body with size and digest, or the error; nothing stops the others.

    Addresses of a host stay in one task, which waits `pause` seconds between
    requests; failed requests are tried again after 1, 2, 4, .. seconds.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for frame in frames:
            out = []
            for url in frame["url"]:
                if not first and pause:
                    time.sleep(pause)
                first = False
                out.append((url, *_get(transport, url, tries), dt.datetime.now()))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _FETCHED.split(", ")]).astype({"http_status": "Int32", "file_size_bytes": "Int64"})

    distinct = urls.select(F.trim(column).alias("url")).where("url != ''").distinct()
    if isinstance(transport, Stored):
        return transport.fetched(distinct)
    return distinct.repartition(F.regexp_extract("url", "://([^/]*)", 1)).mapInPandas(run, _FETCHED)


def _get(transport: Transport, url: str, tries: int) -> tuple:
    for attempt in range(tries):
        try:
            status, kind, body = transport.get(url)
        except Exception as e:  # a failed request is a row with its error
            problem, status, kind, body = type(e).__name__, None, None, b""
        else:
            problem = None if status == 200 else f"HTTP {status}"
        if problem is None and len(body) > MOST_BYTES:
            return status, kind, None, len(body), None, "too large"
        if problem is None:
            return status, kind, body, len(body), hashlib.sha256(body).hexdigest(), None
        if status is not None and status not in (429, 500, 502, 503, 504):
            break
        if attempt < tries - 1:
            time.sleep(2**attempt)
    return status, kind, None, None, None, problem


def pages_of(fetched: DataFrame) -> DataFrame:
    """Fetched pages as (page_id, url, html)."""
    ok = fetched.where("error is null")
    return ok.select(F.xxhash64("url").alias("page_id"), "url", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def absolute(href, base: str):
    """Links of a publisher's pages as whole addresses."""
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.lit(base), F.regexp_replace(href, "^/?", "/")))


@dataclass
class Adapter:
    """How a publisher's candidates are found.

    candidates: from listing pages (page_id, html), rows (page_id, href, doc_id, title, date, place).
    paged: the parameter that counts a listing's pages, if it has several; the
    next one is read as long as a page has candidates. detail: from the candidates'
    own pages, rows (page_id, href, title, date) of the report each stands for; without
    it the candidates are the documents. key: what two candidates may not share.
    kinds: types or extensions of its documents.
    """

    source: str
    base: str
    listings: list[str]
    candidates: Callable[[DataFrame], DataFrame]
    paged: str | None = None
    detail: Callable[[DataFrame], DataFrame] | None = None
    key: str = "doc_id"
    kinds: tuple[str, ...] = ("pdf",)


def _anchors(pages: DataFrame, extensions: str) -> DataFrame:
    """(page_id, href, stem, title, place) of links to files with such an extension, in page order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(rf'(?is)(href="[^"]+\.(?:{extensions})"[^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    href, title = F.regexp_extract("a", r'(?i)href="([^"]+)"', 1), F.trim(html.strip_tags(F.regexp_extract("a", r"(?s)>(.*)</a>", 1)))
    return rows.select("page_id", href.alias("href"), text.slug(text.file_stem(href), 80).alias("stem"), title.alias("title"), _place())


def _place(inner=None):
    return F.struct(F.col("pos").cast("int").alias("pos"), (F.lit(0) if inner is None else inner).cast("int").alias("inner")).alias("place")


def _documents(pages: DataFrame) -> DataFrame:
    """Reports that a listing links directly, named by their files; the first year in the address dates them."""
    rows, year = _anchors(pages, "pdf"), F.regexp_extract("href", r"(\d{4})", 1)
    named = F.coalesce(F.nullif("stem", F.lit("")), F.concat(F.lit("bsee-"), F.substring(F.sha2("href", 256), 1, 12)))
    return rows.select("page_id", "href", named.alias("doc_id"), F.coalesce(F.nullif("title", F.lit("")), named).alias("title"), F.when(year != "", F.concat(year, F.lit("-01-01"))).alias("date"), "place")


def _cards(pages: DataFrame) -> DataFrame:
    rows = html.report_cards(pages, placed=True)
    return rows.select("page_id", "href", text.slug(F.regexp_replace("href", "/", ""), 80).alias("doc_id"), F.col("heading").alias("title"), F.lit(None).cast("string").alias("date"), "place")


def _reports(pages: DataFrame) -> DataFrame:
    """Links into the folder of pipeline reports; the next date that the page shows is theirs."""
    pieces = F.split(F.coalesce("html", F.lit("")), r"(?i)(?=<a\s)")
    rows = pages.select("page_id", F.posexplode(pieces).alias("pos", "piece"))
    dated = F.nullif(F.trim(html.strip_tags(F.regexp_extract("piece", r"""(?is)<span[^>]*class=["'](?:[^"']*\s)?date(?:\s[^"']*)?["'][^>]*>(.*?)</span>""", 1))), F.lit(""))
    after = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("date", F.first(dated, ignorenulls=True).over(after)).withColumn("href", F.regexp_extract("piece", r'(?is)\A<a\s[^>]*href="([^"]+)"', 1))
    title = F.trim(html.strip_tags(F.regexp_extract("piece", r"(?is)\A<a\s[^>]*>(.*?)</a>", 1)))
    return rows.where(F.lower("href").contains("/reports/pipeline/")).select("page_id", "href", text.url_doc_id(F.col("href")).alias("doc_id"), title.alias("title"), "date", _place())


def _tables(pages: DataFrame) -> DataFrame:
    name = F.element_at(F.split("href", "/"), -1)
    return _anchors(pages, "csv|xlsx|zip").select("page_id", "href", F.col("stem").alias("doc_id"), F.coalesce(F.nullif("title", F.lit("")), name).alias("title"), F.lit(None).cast("string").alias("date"), "place")


# Where the publishers list their reports and data.
ADAPTERS: dict[str, Adapter] = {
    a.source: a
    for a in (
        Adapter("csb", "https://www.csb.gov", ["https://www.csb.gov/investigations/completed-investigations/"], _cards, paged="pg", detail=html.detail_reports),
        Adapter("bsee", "https://www.bsee.gov", [f"https://www.bsee.gov/what-we-do/incident-investigations/offshore-incident-investigations/{k}-investigation-reports" for k in ("district", "panel")], _documents),
        Adapter("tsb", "https://www.tsb.gc.ca", ["https://www.tsb.gc.ca/eng/reports/pipeline/index.html"], _reports, kinds=("html",)),
        Adapter("phmsa", "https://www.phmsa.dot.gov", ["https://www.phmsa.dot.gov/data-and-statistics/pipeline/data-and-statistics-overview"], _tables, key="url", kinds=("csv", "xlsx", "zip")),
    )
}


def frontier_of(adapter: Adapter, pages: DataFrame) -> DataFrame:
    """What a round's pages lead to: the next page of each listing that has candidates, and the candidates' own pages."""
    listing = pages.where("kind = 'listing'")
    found = _candidates(adapter, listing)
    none = F.lit(None).cast("struct<pos:int,inner:int>")
    out = found.select(F.col("link").alias("url"), F.lit("detail").alias("kind"), "number", F.col("page_id").alias("found_on"), "place")
    if not adapter.paged:
        return out
    after = F.concat(F.regexp_replace("url", r"\d+\z", ""), (F.col("number") + 1).cast("string"))
    more = listing.join(found.select(F.col("page_id").alias("url")).distinct(), "url", "left_semi")
    return out.union(more.select(after.alias("url"), F.lit("listing").alias("kind"), (F.col("number") + 1).alias("number"), F.col("url").alias("found_on"), none.alias("place")))


def _candidates(adapter: Adapter, listing: DataFrame) -> DataFrame:
    """The candidates of listing pages with `link`, their whole address, and the number of their page."""
    found = adapter.candidates(listing.select(F.col("url").alias("page_id"), "html"))
    return found.withColumn("link", absolute(F.col("href"), adapter.base)).join(listing.select(F.col("url").alias("page_id"), "number"), "page_id")


def results_of(adapter: Adapter, pages: DataFrame) -> DataFrame:
    """(doc_id, title, date, page_url, url, source, number, place) of a crawl's pages, each key once, the first by page and place."""
    pages = pages.where("error is null")
    found = _candidates(adapter, pages.where("kind = 'listing'"))
    if adapter.detail:
        own = adapter.detail(pages.where("kind = 'detail'").select(F.col("url").alias("page_id"), "html"))
        own = own.select(F.col("page_id").alias("link"), absolute(F.col("href"), adapter.base).alias("url"), F.col("title").alias("own_title"), F.col("date").alias("own_date"))
        found = found.join(own, "link").withColumn("page_url", F.col("link")).withColumn("title", F.coalesce("own_title", "title")).withColumn("date", F.coalesce("own_date", "date"))
    else:
        found = found.withColumn("url", F.col("link")).withColumn("page_url", F.col("page_id"))
    rows = found.select("doc_id", "title", "date", "page_url", "url", F.lit(adapter.source).alias("source"), "number", "place")
    return html.first_seen(rows, adapter.key, "number", "place", "url")


def discover(spark: SparkSession, source: str, transport: Transport | Stored, listings: list[str] | None = None, limit: int | None = None, pause: float = 0.0, path: str | None = None) -> DataFrame:
    """(doc_id, title, date, page_url, url, source) of a publisher's candidates, in the order of its pages if `limit` cuts them.

    The crawl's pages are written under `path`; a crawl that finds its own there goes on where it stopped.
    """
    if source not in ADAPTERS:
        raise ValueError(f"unknown source {source!r}; known: {sorted(ADAPTERS)}")
    adapter = ADAPTERS[source]
    start = [f"{u}?{adapter.paged}=1" if adapter.paged else u for u in listings or adapter.listings]
    seeds = spark.createDataFrame([(u, "listing", 1 if adapter.paged else k + 1, None, None) for k, u in enumerate(start)], FRONTIER)
    expand = (lambda pages: frontier_of(adapter, pages)) if adapter.detail else (lambda pages: spark.createDataFrame([], FRONTIER))
    enough = (lambda pages: results_of(adapter, pages).count() >= limit) if limit is not None else None
    pages = crawl(spark, seeds, lambda urls: fetch(urls, transport, pause), expand, path or work_folder(spark, "crawl"), enough)
    found = results_of(adapter, pages)
    found = found.orderBy("number", "place", "url").limit(limit) if limit is not None else found
    return found.drop("number", "place")


def download(candidates: DataFrame, transport: Transport | Stored, pause: float = 0.0, tries: int = 3, kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest rows of the candidates' documents, and their contents (sha256, content).

    What has neither the type nor the extension of a document of its source (or of
    `kinds`) is not downloaded, whatever came back.
    """
    fetched = fetch(candidates, transport, pause, tries)
    met = candidates.join(fetched, "url", "left")
    none = lambda t: F.lit(None).cast(t)
    known = {a.source: a.kinds for a in ADAPTERS.values()}
    allowed = F.array(*map(F.lit, kinds)) if kinds else F.coalesce(F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("source")], F.array(F.lit("pdf")))
    ending = F.regexp_extract(F.lower(F.regexp_replace("url", r"[?#].*", "")), r"\.([a-z0-9]+)\z", 1)
    is_document = F.array_contains(allowed, ending) | F.exists(allowed, lambda k: F.lower(F.coalesce("content_type", F.lit(""))).contains(k))
    came = F.col("error").isNull() & F.col("sha256").isNotNull()
    got = came & is_document
    problem = F.when(came & ~is_document, F.concat(F.lit("Not a "), F.upper(F.array_join(allowed, "/")), F.lit(": "), F.coalesce("content_type", F.lit("")))).otherwise(F.col("error"))
    rows = met.select(
        "source", F.col("doc_id").alias("incident_id"), "title", F.col("date").alias("date_occurred"), none("string").alias("date_report_released"), F.col("page_url").alias("detail_url"), F.col("url").alias("pdf_url"),
        F.when(got, F.concat("source", F.lit("/pdfs/"), "doc_id", F.lit(".pdf"))).alias("pdf_path"), got.alias("downloaded"),
        "retrieved_at", "http_status", "content_type", F.when(got, F.col("file_size_bytes")).alias("file_size_bytes"), F.when(got, F.col("sha256")).alias("sha256"), problem.alias("error"),
    )
    kept = met.where(got).select("sha256", "content").dropDuplicates(["sha256"])
    return rows, kept

"""Queries on readers and flatteners over documents that are made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions.vocabulary import FACTORS
from ..session import work_folder
from ..sources import connectors, crawl, files
from ..sources import incidents as documents
from .adapters import CONTROLS
from .models import _COERCED, _payloads
from .registry import query, table


def _parsed(spark, sf):
    """The drifting documents, as files in folders of publishers."""
    key = F.col("incident_id")
    folder = F.when(key % 3 == 0, "csb").when(key % 3 == 1, "other").otherwise("TSB")
    rows = _payloads(spark, sf).withColumn("json_path", F.concat(F.lit("data/"), folder, F.lit("/"), key.cast("string"), F.lit(".json")))
    return rows.withColumn("incident_id", key.cast("string"))


_PATH = "'data/' || CASE incident_id % 3 WHEN 0 THEN 'csb' WHEN 1 THEN 'other' ELSE 'TSB' END || '/' || incident_id || '.json'"
_FLAGS = ", ".join(f"'' AS incident__pifs__{c}__{f}_value, {'incident_id % 2 = 0' if f == 'competence' else 'false'} AS incident__pifs__{c}__{f}_mentioned" for c, names in FACTORS.items() for f in names)
_BLANKS = ["source__doc_type", "source__url", "source__title", "source__date_published", "source__date_occurred", "context__region", "context__operator", "context__operating_phase", "event__top_event", "event__costs", "context__materials"]


@query(
    "flat_incident_documents",
    f"""SELECT CAST(incident_id AS VARCHAR) AS incident_id, CASE incident_id % 3 WHEN 0 THEN 'CSB' WHEN 1 THEN 'UNKNOWN' ELSE 'TSB' END AS source_agency, CASE incident_id % 3 WHEN 0 THEN 'csb' WHEN 1 THEN 'other' ELSE 'TSB' END AS provider_bucket,
    {", ".join(f"'' AS incident__{b}" for b in _BLANKS)}, CASE incident_id % 3 WHEN 0 THEN 'fire; spill' WHEN 1 THEN '' ELSE '7' END AS incident__event__incident_type, CASE WHEN incident_id % 4 <> 0 THEN 's' ELSE '' END AS incident__event__summary,
    {_FLAGS}, {_PATH} AS json_path FROM good""",
    CONTROLS,
    _COERCED,
)
def flat_incident_documents(spark, sf):
    return documents.flat_incidents(_parsed(spark, sf))


@query(
    "flat_control_documents",
    f"""SELECT CAST(incident_id AS VARCHAR) AS incident_id, pos AS control_seq, control_id, '' AS name, CASE WHEN k % 7 = 0 THEN 'x' WHEN k % 3 = 0 THEN CASE WHEN side = 'prevention' THEN 'left' ELSE 'Recovery' END ELSE side END AS side, '' AS barrier_role, '' AS barrier_type,
    CASE WHEN lod = 99 THEN 'Other' WHEN k % 2 = 0 OR k % 5 = 0 THEN CAST(lod AS VARCHAR) ELSE line_of_defense END AS line_of_defense, '' AS lod_basis, '' AS linked_threat_ids, '' AS linked_consequence_ids,
    CASE WHEN k % 6 = 5 THEN '' WHEN k % 2 = 0 THEN coalesce(CASE was WHEN 'active' THEN 'in place' WHEN 'failed' THEN 'Broken' WHEN 'not_installed' THEN 'missing' WHEN 'degraded' THEN 'partial' END, was, '') ELSE coalesce(was, '') END AS barrier_status, false AS barrier_failed,
    CASE k % 4 WHEN 0 THEN '["a","b"]' WHEN 2 THEN '5' ELSE coalesce(told, '') END AS human_contribution_value, false AS barrier_failed_human, '' AS confidence, 0 AS supporting_text_count, {_PATH} AS json_path FROM coerced""",
    CONTROLS,
    _COERCED,
)
def flat_control_documents(spark, sf):
    return documents.flat_controls(_parsed(spark, sf)).withColumn("control_seq", F.col("control_seq").cast("long"))


@query("aggregated_documents", f"SELECT CAST(incident_id AS VARCHAR) AS incident_id, {_PATH} AS source_file FROM good", CONTROLS, _COERCED)
def aggregated_documents(spark, sf):
    return documents.aggregated(_parsed(spark, sf)).select("incident_id", "source_file")


@query(
    "text_blocks",
    """SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_occurred, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS facility, 'first line  goes on' AS description,
    CASE WHEN o_orderkey % 3 = 0 THEN 'a|b c' ELSE '' END AS causes, 'Valve|' || o_orderstatus AS prevention_barriers FROM orders WHERE o_orderkey % 5 <> 0""",
)
def text_blocks(spark, sf):
    """Two blocks a text: an incident, which every fifth has no description, and one without an id."""
    key = F.col("o_orderkey")
    date = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("some day")
    facility = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("Facility: "), "o_orderpriority", F.lit("\n")))
    causes = F.when(key % 3 == 0, "Causes: a, b c,\n").otherwise("")
    described = F.when(key % 5 == 0, "").otherwise("Description: first line\n goes on\n")
    body = F.concat(F.lit("ID: "), key.cast("string"), F.lit("\nDate: "), date, F.lit("\n"), facility, described, causes, F.lit("Prevention Barriers: Valve,"), "o_orderstatus", F.lit("\n\nDescription: no id\n"))
    rows = files.text_blocks(table(spark, sf, "orders").select(body.alias("text")))
    return rows.select("incident_id", "date_occurred", "facility", "description", F.array_join("causes", "|").alias("causes"), F.array_join("prevention_barriers", "|").alias("prevention_barriers"))


@query("bulk_candidates", "SELECT 'r-' || o_orderkey AS doc_id, '' AS url, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'PHMSA incident R ' || o_orderkey END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, 'phmsa' AS source FROM orders")
def bulk_candidates(spark, sf):
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.concat(F.lit(" R "), key.cast("string")).alias("REPORT_NUMBER"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("Narrative"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Incident_Date"))
    return files.bulk_candidates(rows).drop("page_url")


def _linked(spark, sf):
    """Pages with links to documents, data, numbered reports and cards."""
    k = F.col("page_id").cast("string")
    links = F.concat(
        F.lit('<a href="/d/r'), k, F.lit('.pdf"> Fire of 2019 no '), k, F.lit('</a> <a href="/d/r'), k, F.lit('.pdf">again</a> <a href="/t/t'), k, F.lit('.ZIP?v=1">t</a> <a href="/r/p20h'), F.format_string("%04d", F.col("page_id") % 10_000),
        F.lit('/x.html">r</a></td><td>2020-05-06</td>'),
    )
    cards = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="/gas-leak-'), k, F.lit('/">x</a> <a href="/about/">a</a> Full investigation details'))).otherwise(F.concat(F.lit('<a href="/pump-'), k, F.lit('/"><h3>Pump</h3></a>')))
    return table(spark, sf, "pages").select("page_id", F.concat(links, cards).alias("html"))


@query("pdf_anchors", "SELECT '/d/r' || page_id || '.pdf' AS url, 'fire-of-2019-no-' || page_id AS doc_id, 'Fire of 2019 no ' || page_id AS title, '2019-01-01' AS date FROM pages")
def pdf_anchors(spark, sf):
    return html.pdf_anchors(_linked(spark, sf))


@query("data_links", "SELECT page_id, '/t/t' || page_id || '.ZIP?v=1' AS href FROM pages")
def data_links(spark, sf):
    return html.data_links(_linked(spark, sf))


@query("listing_links", "SELECT DISTINCT printf('P20H%04d', page_id % 10000) AS report_id, printf('/r/p20h%04d/x.html', page_id % 10000) AS href, '2020-05-06' AS date FROM pages")
def listing_links(spark, sf):
    return html.listing_links(_linked(spark, sf))


@query("report_cards", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/gas-leak-' || page_id || '/' ELSE '/pump-' || page_id || '/' END AS href, CASE WHEN page_id % 2 = 0 THEN 'Gas Leak ' || page_id ELSE 'Pump' END AS heading FROM pages")
def report_cards(spark, sf):
    return html.report_cards(_linked(spark, sf))


def _details(spark, sf):
    """Pages as detail pages: with a dated final report behind an appendix, with scored documents, with a date in words, or as they are."""
    k, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    final = F.concat(F.lit("<h1>Case <b>"), k, F.lit('</b></h1><p>Final Report Released On: </strong> 03/04/2019</p><a href="/file.aspx?DocumentId=1'), k, F.lit('">Appendix</a> <a class="d" href="/File.aspx?documentid=2'), k, F.lit('"><i>Report</i></a> <a href="/final_report.pdf">x</a>'))
    scored = F.concat(F.lit('<p>Since March 5, 2020</p><a href="/assets/recommendation/final_report'), k, F.lit('.pdf">r</a> <a href="/b/report'), k, F.lit('.pdf">a</a> <link href="/c/Final'), k, F.lit('.PDF"> <a href="/d/final'), k, F.lit('.pdf">b</a>'))
    named = F.concat(F.lit('<h1> </h1>May 45, 2020 <a href="/e/summary.pdf">s</a><a href="/e/'), k, F.lit('.pdf">The FINAL report</a>'))
    start = F.when(kind == 0, final).when(kind == 1, scored).when(kind == 2, named).otherwise("")
    return table(spark, sf, "pages").select("page_id", F.concat(start, F.coalesce("html", F.lit(""))).alias("html"))


_DETAILS = """details AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<h1>Case <b>' || page_id || '</b></h1><p>Final Report Released On: </strong> 03/04/2019</p><a href="/file.aspx?DocumentId=1' || page_id || '">Appendix</a> <a class="d" href="/File.aspx?documentid=2' || page_id || '"><i>Report</i></a> <a href="/final_report.pdf">x</a>'
   WHEN 1 THEN '<p>Since March 5, 2020</p><a href="/assets/recommendation/final_report' || page_id || '.pdf">r</a> <a href="/b/report' || page_id || '.pdf">a</a> <link href="/c/Final' || page_id || '.PDF"> <a href="/d/final' || page_id || '.pdf">b</a>'
   WHEN 2 THEN '<h1> </h1>May 45, 2020 <a href="/e/summary.pdf">s</a><a href="/e/' || page_id || '.pdf">The FINAL report</a>' ELSE '' END || coalesce(html, '') AS html FROM pages),
 anchors AS (SELECT page_id, pos, regexp_extract(a, '(?i)href="([^"]+)"', 1) AS href, lower(regexp_replace(a, '<[^>]+>', '', 'g')) AS shown
   FROM (SELECT page_id, unnest(range(len(f))) AS pos, unnest(f) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)(<a\\s[^>]*?href="[^"]+"[^>]*?>.*?</a>)', 1) AS f FROM details) WHERE len(f) > 0)),
 hrefs AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS h FROM details) WHERE len(h) > 0),
 choices AS (SELECT page_id, href, pos, 0 AS minus, CASE WHEN contains(shown, 'appendix') THEN 1 ELSE 0 END AS tier FROM anchors WHERE regexp_matches(href, '(?i)/file\\.aspx\\?DocumentId=[0-9]+') OR (contains(shown, 'final report') AND lower(href) LIKE '%.pdf')
   UNION ALL SELECT page_id, href, pos, CASE WHEN contains(lower(href), '/assets/recommendation/') THEN 10 ELSE 0 END + CASE WHEN contains(lower(href), 'status_change_summary') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(href), '/scs[^/]*\\.pdf$') THEN 8 ELSE 0 END
     - CASE WHEN contains(lower(href), 'final') THEN 3 ELSE 0 END - CASE WHEN contains(lower(href), 'investigation') THEN 2 ELSE 0 END - CASE WHEN contains(lower(href), 'report') THEN 1 ELSE 0 END, 2 FROM hrefs WHERE lower(href) LIKE '%.pdf'),
 reports AS (SELECT page_id, href, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS title,
     strftime(coalesce(try_strptime(regexp_extract(html, 'Final Report Released On:\\s*</strong>\\s*([0-9]{2}/[0-9]{2}/[0-9]{4})', 1), '%m/%d/%Y'), try_strptime(regexp_extract(html, '(\\w+ [0-9]{1,2}, [0-9]{4})', 1), '%B %d, %Y'), try_strptime(regexp_extract(html, '(\\w+ [0-9]{1,2}, [0-9]{4})', 1), '%b %d, %Y')), '%Y-%m-%d') AS date
   FROM (SELECT page_id, arg_min(href, (tier, minus, pos)) AS href FROM choices GROUP BY page_id) JOIN details USING (page_id))"""


@query("best_reports", "SELECT page_id, href, title, date FROM reports", _DETAILS)
def best_reports(spark, sf):
    return html.detail_reports(_details(spark, sf))


@query(
    "crawled_reports",
    "SELECT 'page-' || page_id AS doc_id, coalesce(title, 'Page ' || page_id) AS title, date, 'https://www.csb.gov/page-' || page_id || '/' AS page_url, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE 'https://www.csb.gov' || href END AS url FROM reports",
    _DETAILS,
)
def crawled_reports(spark, sf):
    """A crawl of a site that the pages make: listings of 500 cards in chains of four pages, and the pages as details."""
    adapter, k, each, chain = connectors.ADAPTERS["csb"], F.col("page_id"), 500, 4
    base, number = adapter.base, F.floor(F.col("page_id") / each)
    details = _details(spark, sf).select(F.concat(F.lit(f"{base}/page-"), k, F.lit("/")).alias("url"), F.col("html").cast("binary").alias("content"))
    card = F.concat(F.lit('<a href="/page-'), k, F.lit('/"><h3>Page '), k, F.lit("</h3></a>"))
    address = F.concat(F.lit(f"{base}/list-"), F.floor(F.col("n") / chain), F.lit("/?pg="), F.col("n") % chain + 1)
    cards = table(spark, sf, "pages").select(number.alias("n"), card.alias("card")).groupBy("n").agg(F.concat_ws(" ", F.collect_list("card")).alias("html"))
    site = details.union(cards.select(address, F.col("html").cast("binary")))
    seeds = cards.where(F.col("n") % chain == 0).select(address.alias("url"), F.lit("listing").alias("kind"), F.lit(1).alias("number"), F.lit(None).cast("string").alias("found_on"), F.lit(None).cast("struct<pos:int,inner:int>").alias("place"))
    stored = connectors.Stored(site)
    pages = crawl.crawl(spark, seeds, lambda urls: connectors.fetch(urls, stored), lambda p: connectors.frontier_of(adapter, p), work_folder(spark, "crawl"))
    return connectors.results_of(adapter, pages).select("doc_id", "title", "date", "page_url", "url")


@query(
    "pdf_texts",
    """SELECT doc_id, 'pdf' AS extractor_used, array_to_string(list_transform(range(0, len(w), 12), lambda i: array_to_string(w[i + 1:i + 12], ' ')), chr(10)) || chr(10) || chr(10) || 'Page two of ' || doc_id || ' (end)' AS text, 2 AS page_count
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents)""",
)
def pdf_texts(spark, sf):
    """Documents as PDF files of two pages, their words in lines of twelve, and the text that comes back."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)).alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(12))).otherwise(F.array().cast("array<int>"))
    lines = F.transform(starts, lambda i: F.concat(F.lit("("), F.array_join(F.slice("w", i + 1, 12), " "), F.lit(") Tj T*\n")))
    page = lambda number, body: F.concat(F.lit(f"{number} 0 obj\n<< /Type /Page /Contents {number + 1} 0 R >>\nendobj\n{number + 1} 0 obj\n<< /Length 0 >>\nstream\nBT 14 TL 1 0 0 1 72 700 Tm\n"), body, F.lit("ET\nendstream\nendobj\n"))
    head = F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 >>\nendobj\n")
    whole = F.concat(head, page(3, F.array_join(lines, "")), page(5, F.concat(F.lit("(Page two of "), "path", F.lit(" \\(end\\)) Tj\n"))))
    found = files.extract_text(docs.select("path", whole.cast("binary").alias("content")), list(files.EXTRACTORS.items()))
    return found.select(F.col("path").cast("long").alias("doc_id"), "extractor_used", "text", "page_count")

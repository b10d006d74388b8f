"""Web pages: links by pattern, narrative text by a parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import href_score, parse_date


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href) of every link, in page order."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r'(?i)href="([^"]+)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("pos", "href"))


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return first.select("r.*")


class _Narrative(HTMLParser):
    """Text outside script and style: of the first <main> less nav if there is one, else of <body> less header, nav and footer, else of the whole page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.main: list[str] = []
        self.body: list[str] = []
        self.whole: list[str] = []
        self.has_main = self.has_body = self.past_main = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "main", "body", "nav", "header", "footer"):
            self.open.append(tag)
            self.has_main |= tag == "main"
            self.has_body |= tag == "body"

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.past_main |= tag == "main" and "main" not in self.open

    def handle_data(self, data):
        data = data.strip()
        if not data or "script" in self.open or "style" in self.open:
            return
        self.whole.append(data)
        if "main" in self.open and not self.past_main and "nav" not in self.open:
            self.main.append(data)
        if "body" in self.open and not {"nav", "header", "footer"} & set(self.open):
            self.body.append(data)


def narrative_of(html: str | None) -> str:
    parser = _Narrative()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.main if parser.has_main else parser.body if parser.has_body else parser.whole)


@F.pandas_udf(T.StringType())
def narrative(html: pd.Series) -> pd.Series:
    return html.map(narrative_of)


# Folders of listing pages that are no reports.
NOT_REPORTS = ("investigations", "completed-investigations", "current-investigations", "data-quality", "data-quality-", "about", "recommendations", "videos", "news")


def report_cards(pages: DataFrame, window: int = 2000, denied: tuple[str, ...] = NOT_REPORTS, placed: bool = False) -> DataFrame:
    """(page_id, href, heading): links to reports of listing pages, each folder once; with `placed` also their place on the page.

    Where a page calls to "full investigation details", links of one folder in
    the `window` characters before each call count, titled by their folder;
    other pages give links that hold an <h3>, titled by it.
    """
    text = F.coalesce("html", F.lit(""))
    call = F.lit(rf"(?is)(.{{0,{window}}})full\s+investigation\s+details")
    called = text.rlike(r"(?i)full\s+investigation\s+details")
    near = pages.where(called).select("page_id", F.posexplode(F.regexp_extract_all(text, call, F.lit(1))).alias("pos", "w"))
    near = near.select("page_id", "pos", F.posexplode(F.regexp_extract_all("w", F.lit(r'(?i)href="(/[^"/]+/)"'), F.lit(1))).alias("inner", "href"))
    folder = F.regexp_replace("href", "/", "")
    near = near.where((F.length(folder) >= 3) & ~folder.startswith("investigations"))
    near = near.select("page_id", "pos", "inner", "href", F.initcap(F.trim(F.replace(folder, F.lit("-"), F.lit(" ")))).alias("heading"))
    cards = F.regexp_extract_all(text, F.lit(r'(?is)(<a\s[^>]*href="/[^"/]+/"[^>]*>.*?<h3[^>]*>.*?</h3>)'), F.lit(1))
    plain = pages.where(~called).select("page_id", F.posexplode(cards).alias("pos", "card"))
    heading = F.trim(strip_tags(F.regexp_extract("card", r"(?is)<h3[^>]*>(.*?)</h3>", 1)))
    plain = plain.select("page_id", "pos", F.lit(0).alias("inner"), F.regexp_extract("card", r'(?i)href="(/[^"/]+/)"', 1).alias("href"), heading.alias("heading"))
    rows = near.unionByName(plain).withColumn("folder", folder)
    good = rows.where(~F.col("folder").isin(*denied))
    place = F.struct("pos", "inner")
    first = good.groupBy("page_id", "href").agg(F.min_by("heading", place).alias("heading"), F.min(place).alias("place"))
    return first.select("page_id", "href", "heading", *(["place"] if placed else []))


def pdf_anchors(pages: DataFrame) -> DataFrame:
    """(url, doc_id, title, date) of links to documents, each address once, in page order; a year in the title is its first day."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)(<a[^>]+href="[^"]+\.pdf[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    url, text = F.regexp_extract("a", r'(?i)href="([^"]+)"', 1), F.trim(strip_tags(F.col("a")))
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    named = F.when(slug != "", F.substring(slug, 1, 80)).otherwise(F.substring(F.sha2(url, 256), 1, 12))
    rows = rows.select("page_id", "pos", url.alias("url"), named.alias("doc_id"), text.alias("title"), F.when(year != "", F.concat(year, F.lit("-01-01"))).alias("date"))
    return first_seen(rows, "url", "page_id", "pos").select("url", "doc_id", "title", "date")


def data_links(pages: DataFrame, extensions: tuple[str, ...] = ("zip", "csv", "xlsx", "txt")) -> DataFrame:
    """(page_id, href) of links to data files."""
    return links(pages).where(F.lower("href").rlike(rf"\.({'|'.join(extensions)})([?#].*)?$")).select("page_id", "href").distinct()


def listing_links(pages: DataFrame) -> DataFrame:
    """(report_id, href, date): links to numbered reports, with the date in the cell that follows."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)(<a[^>]+href="[^"]*/p\d{2}[a-z]\d{4}/[^"]*"[^>]*>.*?</a>(?:\s*</?(?:td|span|time)[^>]*>)*\s*(?:\d{4}-\d{2}-\d{2})?)'), F.lit(1))
    rows = pages.select(F.explode(found).alias("a"))
    report = F.upper(F.regexp_extract("a", r"(?i)/(p\d{2}[a-z]\d{4})/", 1))
    return rows.select(report.alias("report_id"), F.regexp_extract("a", r'(?i)href="([^"]+)"', 1).alias("href"), F.nullif(F.regexp_extract("a", r"(\d{4}-\d{2}-\d{2})\s*\z", 1), F.lit("")).alias("date")).distinct()


def document_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, anchor) of every link with the text it shows, in page order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)(<a\s[^>]*?href="[^"]+"[^>]*?>.*?</a>)'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "pos", F.regexp_extract("a", r'(?i)href="([^"]+)"', 1).alias("href"), F.trim(strip_tags(F.col("a"))).alias("anchor"))


def best_report(candidates: DataFrame, key: str, score: Column) -> DataFrame:
    """The link with the highest score of each key; ties go to the first address."""
    return candidates.groupBy(key).agg(F.max_by(F.struct(*candidates.columns), F.struct(score, F.col("href"))).alias("r")).select("r.*")


def heading(html: Column) -> Column:
    """The first <h1> without its tags, or null."""
    return F.nullif(F.trim(strip_tags(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1))), F.lit(""))


def released_on(html: Column) -> Column:
    """The date that a page gives for its final report, else the first one written with a month's name; null where that is no date."""
    stated = F.regexp_extract(html, r"Final Report Released On:\s*</strong>\s*(\d{2}/\d{2}/\d{4})", 1)
    return parse_date(F.coalesce(F.nullif(stated, F.lit("")), F.regexp_extract(html, r"(\w+ \d{1,2}, \d{4})", 1)))


#: Fixed value: addresses that publishers give final reports.
FINAL_REPORT = r"(?i)/file\.aspx\?DocumentId=\d+"


def detail_reports(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, href, title, date): the report that a detail page stands for; pages without one give no row.

    First come links to numbered documents, and PDFs that a link calls a final
    report, those that are no appendix before others, in page order. Without such,
    the PDF address with the highest score counts, the first of equals.
    """
    pdf = F.lower("href").endswith(".pdf")
    final = F.col("href").rlike(FINAL_REPORT) | (F.lower("anchor").contains("final report") & pdf)
    tier = F.when(F.lower("anchor").contains("appendix"), 1).otherwise(0)
    keyed = pages.select(F.col(id_col).alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    named = document_links(keyed).where(final).select("page_id", tier.alias("tier"), F.lit(0).alias("score"), "pos", "href")
    plain = links(keyed).where(pdf).select("page_id", F.lit(2).alias("tier"), (-href_score(F.col("href"))).alias("score"), "pos", "href")
    best = named.union(plain).groupBy("page_id").agg(F.min_by("href", F.struct("tier", "score", "pos")).alias("href"))
    about = keyed.select("page_id", heading(F.col("html")).alias("title"), released_on(F.col("html")).alias("date"))
    return best.join(about, "page_id").select(F.col("page_id").alias(id_col), "href", "title", "date")

"""Queries over documents, pages and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import retrieval
from ..streaming import manifests as streams
from .registry import query, table

#: Terms that occur in the test prose; the defaults of the operator are those of the domain.
PRIMARY, SECONDARY, CONTEXT = ["ing", "keit", "que"], ["the", "und"], ["of", "der", "la", "the"]

_GARBLED = "garbled AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || repeat('(cid:7)', 6) WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN repeat('12345 ', 100) ELSE text END AS text FROM documents)"
_BLANK = r"[\s\p{Z}]"  # white space of any script


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


_MEASURED = rf"""stripped AS (SELECT doc_id, source, {_strip("coalesce(text, '')")} AS t FROM garbled),
 measured AS (SELECT doc_id, source, CAST(length(t) AS INTEGER) AS text_len,
  CASE WHEN t <> '' THEN round(length(regexp_replace(t, '\P{{L}}', '', 'g')) / length(t)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS alpha_ratio,
  CASE WHEN t <> '' THEN round((length(t) - length(regexp_replace(t, '{_BLANK}', '', 'g'))) / length(t)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS whitespace_ratio,
  CAST(len(regexp_extract_all(t, '\(cid:\d+\)')) AS INTEGER) AS cid_count, CASE WHEN t <> '' THEN round((length(t) - length(regexp_replace(t, '\(cid:\d+\)', '', 'g'))) / length(t)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS cid_ratio FROM stripped)"""
_GATED = """gated AS (SELECT doc_id, source, CASE WHEN text_len = 0 THEN 'EMPTY_TEXT' WHEN text_len < 400 THEN 'TOO_SHORT' WHEN cid_ratio > 0.01 OR cid_count >= 5 THEN 'CID_ENCODING_GIBBERISH'
  WHEN alpha_ratio < 0.55 THEN 'LOW_ALPHA_GIBBERISH' ELSE 'OK' END AS status FROM measured)"""


def _garbled(spark, sf):
    garbled = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("(cid:7)" * 6))).when(F.col("doc_id") % 13 == 0, "").when(F.col("doc_id") % 17 == 0, "12345 " * 100).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "source", garbled.alias("text"))


def _gated(spark, sf):
    measured = _garbled(spark, sf).select("doc_id", "source", *[c.alias(n) for n, c in text.text_metrics(F.col("text")).items()])
    return measured.select("doc_id", "source", text.extraction_status(F.col("text_len"), F.col("alpha_ratio"), F.col("cid_count"), F.col("cid_ratio")).alias("status"))


@query("text_metrics", "SELECT doc_id, text_len, alpha_ratio, whitespace_ratio, cid_count, cid_ratio FROM measured", _GARBLED, _MEASURED)
def text_metrics(spark, sf):
    return _garbled(spark, sf).select("doc_id", *[c.alias(n) for n, c in text.text_metrics(F.col("text")).items()])


@query("extraction_gate", "SELECT doc_id, status FROM gated", _GARBLED, _MEASURED, _GATED)
def extraction_gate(spark, sf):
    return _gated(spark, sf).select("doc_id", "status")


@query("gate_summary", "SELECT status, count(*) AS n FROM gated GROUP BY 1", _GARBLED, _MEASURED, _GATED)
def gate_summary(spark, sf):
    return _gated(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


#: Every special character once: quotes of all kinds, dashes that stay, blanks of all kinds, control and format characters.
_ODD = "  «a» ‘b’ “c” d–e—f    \t x   y ​z\u0007­w\r\n   \n\n\n\n\n\n end  "
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]"
_PLAIN = "translate(coalesce(text, ''), chr(160) || '‘’“”«»', ' ' || repeat(chr(39), 2) || repeat(chr(34), 4))"
_SQUEEZED = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '{_CONTROL}', '', 'g'), '[ \t\r\p{{Z}}]{{3,}}', '  ', 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g')"


@query(
    "normalized_text",
    f"""SELECT doc_id, sha256({_strip(f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), chr(10))")}) AS digest FROM (SELECT doc_id, {_SQUEEZED} AS t
      FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text || $odd${_ODD}$odd$ || text ELSE text END AS text FROM documents))""",
)
def normalized_text(spark, sf):
    odd = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(_ODD), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.normalize_text(odd), 256).alias("digest"))


_WORDS = "words AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+') AS w FROM documents)"


def _hits(terms):
    return " + ".join(f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms)


_SCORED = f"""counted AS (SELECT doc_id, {_hits(PRIMARY)} AS p, {_hits(SECONDARY)} AS s, {_hits(CONTEXT)} AS h,
  concat_ws('|', {", ".join(f"CASE WHEN list_contains(w, '{t}') THEN '{t}' END" for t in dict.fromkeys([*PRIMARY, *SECONDARY, *CONTEXT]))}) AS matched_terms FROM words),
 scored AS (SELECT doc_id, CAST(p AS INTEGER) AS primary_hits, CAST(s AS INTEGER) AS secondary_hits, CAST(h AS INTEGER) AS context_hits, CAST(2 * p + s + h AS INTEGER) AS loc_score,
  (p >= 1 AND h >= 1) OR (s >= 1 AND h >= 2) AS loc_flag, matched_terms FROM counted)"""


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return text.keyword_scores(docs, "text", PRIMARY, SECONDARY, CONTEXT).drop("text")


@query("loc_scores", "SELECT * FROM scored", _WORDS, _SCORED)
def loc_scores(spark, sf):
    return _scored(spark, sf)


@query(
    "loc_fusion",
    """SELECT doc_id, CASE WHEN status <> 'OK' THEN 'EXTRACTION_FAILED' WHEN doc_id % 19 = 0 THEN 'TEXT_FILE_MISSING' WHEN loc_flag THEN 'TRUE' ELSE 'FALSE' END AS final_label,
    CASE WHEN status = 'OK' AND doc_id % 19 <> 0 THEN loc_score END AS loc_score FROM gated JOIN scored USING (doc_id)""",
    _GARBLED,
    _MEASURED,
    _GATED,
    _WORDS,
    _SCORED,
)
def loc_fusion(spark, sf):
    found = _scored(spark, sf).where("doc_id % 19 != 0").select("doc_id", "loc_score", "loc_flag")
    return retrieval.fuse_labels(_gated(spark, sf), found)


@query("loc_summary", "SELECT count(*) AS documents, count(*) FILTER (loc_flag) AS flagged, count(*) FILTER (loc_flag) / count(*)::DOUBLE AS share FROM scored", _WORDS, _SCORED)
def loc_summary(spark, sf):
    return _scored(spark, sf).agg(F.count("*").alias("documents"), F.count_if("loc_flag").alias("flagged"), (F.count_if("loc_flag") / F.count("*")).alias("share"))


@query("loc_top5", "SELECT doc_id, loc_score FROM scored ORDER BY loc_score DESC, doc_id LIMIT 5", _WORDS, _SCORED)
def loc_top5(spark, sf):
    return _scored(spark, sf).select("doc_id", "loc_score").orderBy(F.desc("loc_score"), "doc_id").limit(5)


_LINKS = """links AS (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS h FROM pages) WHERE len(h) > 0)"""


@query("html_links", "SELECT * FROM links", _LINKS)
def html_links(spark, sf):
    return html.links(table(spark, sf, "pages"))


@query("html_title", "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


_SHAPES = r"""shaped AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(replace(html, '<article>', '<main><nav>skip</nav>'), '</article>', '</main>') WHEN 1 THEN '<p>no <b>body</b></p><style>x</style><nav>kept</nav>' ELSE html END AS h FROM pages),
 cleaned AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', chr(1), 'g') AS h FROM shaped),
 parts AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(regexp_extract(h, '(?is)<main>(.*?)</main>', 1), '(?is)<nav>.*?</nav>', chr(1), 'g') WHEN 1 THEN h
   ELSE regexp_replace(regexp_replace(regexp_extract(h, '(?is)<body>(.*?)(?:</body>|\z)', 1), '(?is)<nav>.*?</nav>', chr(1), 'g'), '(?is)<footer>.*?</footer>', chr(1), 'g') END AS t FROM cleaned)"""
_NAMED = {"&nbsp;": "chr(160)", "&copy;": "'©'", "&middot;": "'·'", "&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&#x27;": "chr(39)", "&#39;": "chr(39)", "&amp;": "'&'", "&amp": "'&'"}
_ENTITIES = reduce(lambda x, e: f"replace({x}, '{e[0]}', {e[1]})", _NAMED.items(), "x")


@query(
    "html_narrative",
    f"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '<[^>]+>', chr(1), 'g'), chr(1)), lambda x: {_strip(_ENTITIES)}), lambda x: x <> ''), chr(10)) AS narrative FROM parts",
    _SHAPES,
)
def html_narrative(spark, sf):
    """Pages with a main part, with a body only, and without either."""
    main = F.replace(F.replace("html", F.lit("<article>"), F.lit("<main><nav>skip</nav>")), F.lit("</article>"), F.lit("</main>"))
    page = F.when(F.col("page_id") % 3 == 0, main).when(F.col("page_id") % 3 == 1, F.lit("<p>no <b>body</b></p><style>x</style><nav>kept</nav>")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", html.narrative(page).alias("narrative"))


@query("document_links", """SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(a, '(?i)href="([^"]+)"', 1) AS href, trim(regexp_replace(a, '<[^>]+>', '', 'g')) AS anchor FROM (SELECT page_id, unnest(range(len(f))) AS pos, unnest(f) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)(<a\\s[^>]*?href="[^"]+"[^>]*?>.*?</a>)', 1) AS f FROM pages) WHERE len(f) > 0)""".replace("\\\\s", "\\s"))
def document_links(spark, sf):
    return html.document_links(table(spark, sf, "pages"))


@query(
    "windowed_failures",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
)
def windowed_failures(spark, sf):
    """The streaming aggregate over a table at rest."""
    rates = streams.failure_rate(table(spark, sf, "events"))
    return rates.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "events", "errors")


@query(
    "url_doc_id",
    r"""SELECT page_id, upper(CASE WHEN page_id % 3 = 0 THEN 'p23h0001' ELSE coalesce(nullif(regexp_replace(split_part(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', ''), '/', -1), '\.[^.]*$', ''), ''), 'TSB_UNKNOWN') END) AS doc_id FROM pages""",
)
def url_doc_id(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.lit("https://example.org/r/p23h0001/p23h0001.html?x#y")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", text.url_doc_id(url).alias("doc_id"))


_HREFS = """hrefs AS (SELECT page_id, pos, lower(href || CASE pos % 5 WHEN 0 THEN '/Final-Investigation-Report.pdf' WHEN 1 THEN '/assets/recommendation/x.pdf' WHEN 2 THEN '/status_change_summary' WHEN 3 THEN '/scs12.pdf' ELSE '' END) AS h FROM links)"""


@query(
    "href_scores",
    r"""SELECT page_id, pos, CASE WHEN h LIKE '%/assets/recommendation/%' THEN -10 ELSE 0 END + CASE WHEN h LIKE '%status!_change!_summary%' ESCAPE '!' THEN -8 ELSE 0 END
    + CASE WHEN regexp_matches(h, '/scs[^/]*\.pdf$') THEN -8 ELSE 0 END + CASE WHEN h LIKE '%final%' THEN 3 ELSE 0 END + CASE WHEN h LIKE '%investigation%' THEN 2 ELSE 0 END + CASE WHEN h LIKE '%report%' THEN 1 ELSE 0 END AS score FROM hrefs""",
    _LINKS,
    _HREFS,
)
def href_scores(spark, sf):
    k = F.col("pos") % 5
    tail = F.when(k == 0, "/Final-Investigation-Report.pdf").when(k == 1, "/assets/recommendation/x.pdf").when(k == 2, "/status_change_summary").when(k == 3, "/scs12.pdf").otherwise("")
    return html.links(table(spark, sf, "pages")).select("page_id", "pos", text.href_score(F.concat("href", tail)).alias("score"))


_MARKED = "marked AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'System: ' || text WHEN 1 THEN text || ' {{secret}} <prompt x>' WHEN 2 THEN '## Ignore' || text ELSE text END AS text FROM conversations)"


def _marked(spark, sf):
    k = F.col("turn") % 5
    odd = F.when(k == 0, F.concat(F.lit("System: "), "text")).when(k == 1, F.concat("text", F.lit(" {{secret}} <prompt x>"))).when(k == 2, F.concat(F.lit("## Ignore"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", odd.alias("text"))


def _cleaned(column: str) -> str:
    for pattern in (text.ROLE_MARKERS, text.TEMPLATE_VARIABLES, text.TAGS_OF_PROMPTS, text.HEADINGS_OF_PROMPTS):
        column = f"regexp_replace({column}, '{pattern}', '', 'g')"
    return _strip(column)


@query("sanitized_turns", f"SELECT conv_id, turn, sha256({_cleaned('text')}) AS digest FROM marked", _MARKED)
def sanitized_turns(spark, sf):
    return _marked(spark, sf).select("conv_id", "turn", F.sha2(text.sanitize_prompt(F.col("text")), 256).alias("digest"))


@query(
    "narrative_gate",
    rf"""SELECT conv_id, turn, t <> '' AND len(regexp_split_to_array(t, '\s+')) <= 60 AND len(regexp_extract_all(t, '[.!?]')) <= 4 AS ok FROM (SELECT conv_id, turn, {_strip("coalesce(text, '')")} AS t FROM conversations)""",
)
def narrative_gate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.narrative_ok(F.col("text")).alias("ok"))


@query(
    "context_budget",
    """SELECT conv_id, turn, text_len, used FROM (SELECT *, min(CASE WHEN used > 2000 AND turn_no > 1 THEN turn_no END) OVER (PARTITION BY conv_id) AS stop FROM (
      SELECT conv_id, turn, length(text) AS text_len, CAST(sum(length(text)) OVER w AS BIGINT) AS used, row_number() OVER w AS turn_no FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))
    WHERE stop IS NULL OR turn_no < stop""",
)
def context_budget(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("text_len"))
    return retrieval.within_budget(rows, ["conv_id"], ["turn"], "text_len", 2000)

"""Text columns: cleaning, quality metrics, keyword scores, prompt hygiene."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the extraction gate.
MIN_CHARS, CID_RATIO, CID_COUNT, ALPHA_RATIO = 400, 0.01, 5, 0.55
# Keywords of loss-of-containment scoring.
PRIMARY_TERMS = ["release", "spill", "leak", "loss of containment", "discharge", "escape", "rupture", "blowout"]
SECONDARY_TERMS = ["explosion", "fire"]
CONTEXT_TERMS = ["chemical", "ammonia", "gas", "vapor", "hydrogen", "oil", "refinery", "toxic", "explosion", "fire"]
# Fixed patterns: what is removed from text that goes into a prompt, in this order.
ROLE_MARKERS = r"(?i)(?:(?:^|\n)\s*(?:human|user|assistant|system|ai)\s*:|<\|(?:system|user|assistant|im_start|im_end)\|>|<<\s*/?SYS\s*>>)"
TEMPLATE_VARIABLES = r"\{\{.*?\}\}|\{%.*?%\}"
TAGS_OF_PROMPTS = r"(?i)</?(?:system|instructions|prompt|context|message|tool_use|function_call|result)[^>]*>"
HEADINGS_OF_PROMPTS = r"(?i)(?:^|\n)\s*#{1,3}\s*(?:instructions|system|prompt|override|ignore)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def fixed(x: Column, digits: int) -> Column:
    """A double from 0 to below 16 with so many digits (6 at most), rounded as C and Python do: by its exact binary value, halves to even.

    format_string rounds the shortest decimal text of it instead, halves up; it writes all other values.
    """
    near, power, one = (x >= 0) & (x < 16), F.lit(10**digits), F.lit(1 << 50).cast("decimal(16,0)") * F.lit(1 << 50).cast("decimal(16,0)")
    scaled = F.when(near, x) * F.lit(float(1 << 40))
    high = F.floor(scaled)
    low = ((scaled - high) * F.lit(float(1 << 60))).cast("long")  # both parts are exact: together x times 2^100
    units = (high.cast("decimal(14,0)") * F.lit(1 << 60).cast("decimal(19,0)") + low.cast("decimal(19,0)")) * power.cast("decimal(7,0)")
    rest = units % one
    down = ((units - rest) / one).cast("long")
    twice = rest * F.lit(2)
    n = down + F.when((twice > one) | ((twice == one) & (down % 2 == 1)), 1).otherwise(0)
    exact = F.concat(F.floor(n / power).cast("string"), F.lit("."), F.lpad((n % power).cast("string"), digits, "0"))
    return F.when(near, exact).otherwise(F.format_string(f"%.{digits}f", x))


def normalize_text(text: Column) -> Column:
    """Plain quotes and spaces, no control characters, at most two spaces and three line feeds in a row, trimmed lines; null is empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\u00a0‘’“”«»", " ''\"\"\"\"")
    plain = F.regexp_replace(plain, r"[\p{C}&&[^\n\r\t]]", "")
    plain = F.regexp_replace(plain, r"(?U)[^\S\n]{3,}", "  ")
    plain = F.regexp_replace(plain, r"\n{4,}", "\n\n\n")
    return strip(F.array_join(F.transform(F.split(plain, "\n"), strip), "\n"))


def text_metrics(text: Column) -> dict[str, Column]:
    """Of the stripped text: length, and shares (four digits) of letters, white space and the characters of glyph codes that were not decoded."""
    text = strip(F.coalesce(text, F.lit("")))
    n = F.length(text)
    share = lambda k: F.when(n > 0, F.round(k / n, 4)).otherwise(F.lit(0.0))
    codes = r"\(cid:\d+\)"
    return {
        "text_len": n,
        "alpha_ratio": share(F.length(F.regexp_replace(text, r"\P{L}", ""))),
        "whitespace_ratio": share(F.length(F.regexp_replace(text, r"(?U)\S", ""))),
        "cid_count": F.regexp_count(text, F.lit(codes)),
        "cid_ratio": share(n - F.length(F.regexp_replace(text, codes, ""))),
    }


def extraction_status(text_len: Column, alpha_ratio: Column, cid_count: Column, cid_ratio: Column) -> Column:
    """The first rule that a text fails, else OK."""
    return (
        F.when(text_len == 0, "EMPTY_TEXT")
        .when(text_len < MIN_CHARS, "TOO_SHORT")
        .when((cid_ratio > CID_RATIO) | (cid_count >= CID_COUNT), "CID_ENCODING_GIBBERISH")
        .when(alpha_ratio < ALPHA_RATIO, "LOW_ALPHA_GIBBERISH")
        .otherwise("OK")
    )


def term_count(text: Column, term: str) -> Column:
    """Whole-word occurrences, case-insensitive; words are runs of letters, digits and underscores."""
    word = r"[\p{L}\p{N}_]"
    return F.regexp_count(F.lower(text), F.lit(rf"(?<!{word})\Q{term.lower()}\E(?!{word})"))


def keyword_scores(df: DataFrame, column: str, primary=PRIMARY_TERMS, secondary=SECONDARY_TERMS, context=CONTEXT_TERMS) -> DataFrame:
    """Adds counts of each kind of term, score 2p + s + h, the flag, and the terms that occur.

    All single words are found in one pass over the text, which leaves a short
    list to count in; phrases take a pass each.
    """
    terms = list(dict.fromkeys([*primary, *secondary, *context]))
    words, phrases = [t for t in terms if re.fullmatch(r"\w+", t)], [t for t in terms if not re.fullmatch(r"\w+", t)]
    edge = r"[\p{L}\p{N}_]"
    lower = F.lower(F.coalesce(F.col(column), F.lit("")))
    found = F.regexp_extract_all(lower, F.lit(rf"(?<!{edge})({'|'.join(t.lower() for t in sorted(words, key=len, reverse=True))})(?!{edge})"), F.lit(1)) if words else F.array().cast("array<string>")
    hits = df.withColumns({"__found": found, **{f"__p{k}": term_count(F.col(column), t) for k, t in enumerate(phrases)}})

    def count(kind: list[str]) -> Column:
        wanted = [t.lower() for t in kind if t in words]
        n = F.size(F.filter("__found", lambda x: x.isin(wanted))) if wanted else F.lit(0)
        return sum((F.coalesce(f"__p{k}", F.lit(0)) for k, t in enumerate(phrases) if t in kind), n)

    counted = hits.withColumns({"primary_hits": count(primary), "secondary_hits": count(secondary), "context_hits": count(context)})
    there = lambda t: F.col(f"__p{phrases.index(t)}") > 0 if t in phrases else F.array_contains("__found", t.lower())
    matched = F.array_join(F.array_compact(F.array(*[F.when(there(t), t) for t in terms])), "|")
    p, s, h = F.col("primary_hits"), F.col("secondary_hits"), F.col("context_hits")
    scored = counted.withColumns({"loc_score": 2 * p + s + h, "loc_flag": ((p >= 1) & (h >= 1)) | ((s >= 1) & (h >= 2)), "matched_terms": matched})
    return scored.drop("__found", *[f"__p{k}" for k in range(len(phrases))])


def sanitize_prompt(text: Column) -> Column:
    for pattern in (ROLE_MARKERS, TEMPLATE_VARIABLES, TAGS_OF_PROMPTS, HEADINGS_OF_PROMPTS):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def slug(text: Column, most: int = 50) -> Column:
    """Lower case, marks left out, blanks and dashes as one dash, cut to `most` characters."""
    kept = F.regexp_replace(strip(F.lower(text)), r"(?U)[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(kept, r"(?U)[-\s]+", "-"), 1, most)


def title_of_slug(text: Column) -> Column:
    """A slug as a title: blanks for dashes, every run of letters with a capital."""
    words = F.regexp_extract_all(F.trim(F.replace(text, F.lit("-"), F.lit(" "))), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def parse_date(text: Column, formats=("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-M-d")) -> Column:
    """ISO date of the first format that fits the trimmed text, names of months in any case, else null."""
    clean = F.initcap(F.lower(strip(text)))
    return F.date_format(F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in formats]), "yyyy-MM-dd")


def unquote(text: Column) -> Column:
    """Percent-decoding in which a plus stays a plus; a bad escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def url_doc_id(url: Column) -> Column:
    """A report number in the path, else the last segment without extension, in upper case."""
    report = F.regexp_extract(url, r"(?i)/(p\d{2}[a-z]\d{4})/", 1)
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*", ""), r"/+\z", "")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*\z", "")
    return F.upper(F.coalesce(F.nullif(report, F.lit("")), F.nullif(stem, F.lit("")), F.lit("TSB_UNKNOWN")))


# What speaks for and against a link being a final report.
HREF_SCORES = [(r"/assets/recommendation/", -10), (r"status_change_summary", -8), (r"/scs[^/]*\.pdf$", -8), (r"final", 3), (r"investigation", 2), (r"report", 1)]


def href_score(href: Column) -> Column:
    return sum((F.when(F.lower(href).rlike(p), F.lit(n)).otherwise(F.lit(0)) for p, n in HREF_SCORES), F.lit(0))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*\z", "")


def text_path_of(pdf_path: Column) -> Column:
    """The text file that belongs to a document: the first folder named pdfs becomes text, extension .pdf becomes .txt."""
    plain = F.replace(pdf_path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(plain, r"\A((?:(?!pdfs/)[^/]*/)*?)pdfs(?=/|\z)", "$1text"), r"\.pdf\z", ".txt")


def wait_seconds(text: Column, delay: float, per_minute: int = 30_000, window: int = 65) -> Column:
    """Pause before the next call, from four characters a token."""
    return F.greatest(F.lit(float(delay)), F.length(text) / 4 / per_minute * window)


def narrative(text: Column) -> tuple[Column, Column]:
    """What stands before and after the recommendations heading."""
    parts = F.split(text, r"## Recommendations", 2)
    return strip(F.element_at(parts, 1)), strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))


def narrative_ok(text: Column, words: int = 60, sentences: int = 4) -> Column:
    text = strip(F.coalesce(text, F.lit("")))
    return (text != "") & (F.size(F.split(text, r"\s+")) <= words) & (F.regexp_count(text, F.lit("[.!?]")) <= sentences)


def fill_template(template: str, **values: Column) -> Column:
    """The template with each {{name}} replaced by its column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def compose_barrier_text(name: Column, role: Column, basis: Column) -> Column:
    """Three lines; a basis that is null or blank is N/A."""
    told = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Barrier: "), told(name), F.lit("\nRole: "), told(role), F.lit("\nLOD Basis: "), F.coalesce(F.nullif(basis, F.lit("")), F.lit("N/A")))


def compose_incident_text(top_event: Column, incident_type: Column, phase: Column, materials: Column, summary: Column, recommendations: Column, factor_notes: Column) -> Column:
    """Seven parts; the last three columns but the summary are lists, N/A if empty."""
    told = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c, mark: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, mark)).otherwise("N/A")
    parts = [
        ("Top Event: ", told(top_event)), ("\nIncident Type: ", told(incident_type)), ("\nOperating Phase: ", told(phase)), ("\nMaterials: ", listed(materials, ", ")),
        ("\nSummary: ", told(summary)), ("\nRecommendations:\n", listed(recommendations, "\n")), ("\nPerformance-Influencing Factor Notes:\n", listed(factor_notes, "\n")),
    ]
    return F.concat(*[x for lead, c in parts for x in (F.lit(lead), c)])


def split_barrier_text(text: Column) -> tuple[Column, Column, Column]:
    lines = F.split(text, "\n")
    part = lambda k, lead: F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(k)), F.lit("")), "^" + re.escape(lead), "")
    return part(1, "Barrier: "), part(2, "Role: "), part(3, "LOD Basis: ")


def parse_bool(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text.cast("string"), F.lit("")))).isin("true", "1", "yes")


def safe_filename(text: Column) -> Column:
    """Letters, digits, dots, dashes and underscores stay; every other character is an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_"), r"\A_+|_+\z", "")


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters; null is empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def parent_name(path: Column) -> Column:
    """The folder that a path's last segment lies in, blank for none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))

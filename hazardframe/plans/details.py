"""Queries on the smaller operators: text and path columns, orders, lookups, gates and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text
from ..functions.vocabulary import FACTORS, MODEL_PIFS
from ..operators import cascade, context, coverage, metrics, mining, ml, profiling, retrieval, taxonomy
from ..session import work_folder
from ..sources import files
from .adapters import CONTROLS, INCIDENTS, controls, incidents
from .models import _AUC, _FOLDS, _METRICS, _SCORED, _dealt
from .registry import query, table
from .relations import FAMILIES, FAILED, ITEMS, PAIRS, _GAPS, _items
from .scenarios import _PAIR_SCORES, _SCORES, _scores
from .texts import _strip

_MARK = "CASE p_partkey % 4 WHEN 0 THEN ' Fire & ' || p_name || ' -- Relief! ' WHEN 1 THEN p_name || ' über_x  (2nd)' WHEN 2 THEN '/' || p_name || '?.json ' ELSE p_name || ' ' || p_type END"
_PARTS = f"marked AS (SELECT p_partkey, {_MARK} AS x FROM part)"


def _parts(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    x = F.when(k == 0, F.concat(F.lit(" Fire & "), n, F.lit(" -- Relief! "))).when(k == 1, F.concat(n, F.lit(" über_x  (2nd)"))).when(k == 2, F.concat(F.lit("/"), n, F.lit("?.json "))).otherwise(F.concat(n, F.lit(" "), "p_type"))
    return table(spark, sf, "part").select("p_partkey", x.alias("x"))


_SLUG = rf"substr(regexp_replace(regexp_replace({_strip('lower(x)')}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}-]', '', 'g'), '[-\s\p{{Z}}]+', '-', 'g'), 1, 20)"


@query(
    "slugs",
    rf"""SELECT p_partkey, slug, array_to_string(list_transform(regexp_extract_all(trim(replace(slug, '-', ' ')), '\p{{L}}+|\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title,
    regexp_replace(regexp_replace(x, '[^A-Za-z0-9._-]', '_', 'g'), '^_+|_+$', '', 'g') AS file_name FROM (SELECT p_partkey, x, {_SLUG} AS slug FROM marked)""",
    _PARTS,
)
def slugs(spark, sf):
    slug = text.slug(F.col("x"), 20)
    return _parts(spark, sf).select("p_partkey", slug.alias("slug"), text.title_of_slug(slug).alias("title"), text.safe_filename(F.col("x")).alias("file_name"))


@query(
    "parsed_dates",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def parsed_dates(spark, sf):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    f = lambda pattern: F.date_format(day, pattern)
    written = F.when(k == 0, F.upper(f("MMMM d, yyyy"))).when(k == 1, F.concat(F.lit(" "), f("MMM d, yyyy"))).when(k == 2, f("MM/dd/yyyy")).when(k == 3, f("yyyy-MM-dd")).when(k == 4, f("d MMMM yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", text.parse_date(written).alias("parsed"))


_ABBREVIATED = "abbreviated AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PSV/' || p_name || ' (BOP)' WHEN 1 THEN p_name || ' ESD-valve' WHEN 2 THEN ' capsv ' || p_name || ' h2s.' ELSE p_name END AS x FROM part)"
_WORDS = r"string_split(trim(regexp_replace(regexp_replace(lower(x), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
_EXPANDED = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in taxonomy.ABBREVIATIONS.items()) + " ELSE w END"


@query("normalized_names", f"SELECT p_partkey, array_to_string(list_transform({_WORDS}, lambda w: {_EXPANDED}), ' ') AS name FROM abbreviated", _ABBREVIATED)
def normalized_names(spark, sf):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    x = F.when(k == 0, F.concat(F.lit("PSV/"), n, F.lit(" (BOP)"))).when(k == 1, F.concat(n, F.lit(" ESD-valve"))).when(k == 2, F.concat(F.lit(" capsv "), n, F.lit(" h2s."))).otherwise(n)
    return table(spark, sf, "part").select("p_partkey", taxonomy.normalize_control_name(x).alias("name"))


@query("barrier_texts", "SELECT p_partkey, 'Barrier: ' || p_name || '\nRole: ' || p_type || '\nLOD Basis: ' || CASE WHEN p_partkey % 3 = 0 THEN 'N/A' ELSE p_brand END AS composed, p_name AS name, p_type AS role, CASE WHEN p_partkey % 3 = 0 THEN 'N/A' ELSE p_brand END AS basis FROM part".replace(r"\n", "\n"))
def barrier_texts(spark, sf):
    basis = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).when(F.col("p_partkey") % 2 == 0, "")
    rows = table(spark, sf, "part").select("p_partkey", text.compose_barrier_text(F.col("p_name"), F.col("p_type"), basis).alias("composed"))
    return rows.select("*", *[c.alias(n) for n, c in zip(("name", "role", "basis"), text.split_barrier_text(F.col("composed")), strict=True)])


@query(
    "url_parts",
    r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '100%zz+' ELSE url || ' ü+&' END AS unquoted, coalesce(string_split(url, '/')[-2], '') AS parent, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') AS stem FROM pages""",
)
def url_parts(spark, sf):
    quoted = F.when(F.col("page_id") % 4 == 0, "100%zz+").otherwise(F.concat("url", F.lit("%20%C3%BC+%26")))
    return table(spark, sf, "pages").select("page_id", text.unquote(quoted).alias("unquoted"), text.parent_name(F.col("url")).alias("parent"), text.file_stem(F.col("url")).alias("stem"))


@query("stripped_tags", "SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def stripped_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(html.strip_tags(F.col("html")), 256).alias("digest"))


@query("text_paths", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data/text/' || doc_id || '.txt' WHEN 1 THEN source || '/text/pdfs/' || doc_id || '.txt' ELSE 'mypdfs/' || doc_id || '.PDF' END AS text_path, sha256(coalesce(text, '')) AS digest FROM documents")
def text_paths(spark, sf):
    k, d = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("data/pdfs/"), d, F.lit(".pdf"))).when(k == 1, F.concat("source", F.lit("\\pdfs\\pdfs\\"), d, F.lit(".pdf"))).otherwise(F.concat(F.lit("mypdfs/"), d, F.lit(".PDF")))
    return table(spark, sf, "documents").select("doc_id", text.text_path_of(path).alias("text_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query(
    "turn_checks",
    f"""SELECT conv_id, turn, turn % 4 <> 3 AS truth, greatest(2.5, length(text) / 4.0::DOUBLE / 30000 * 65) AS wait, substr(coalesce(text, ''), 1, 40) AS cut, 'Say: ' || substr(coalesce(text, ''), 1, 40) || ' {{{{other}}}}' AS prompt,
    {_strip("CASE WHEN turn % 2 = 0 THEN role ELSE coalesce(substr(text, 1, 20), '') END")} AS before, CASE WHEN turn % 2 = 0 THEN 'x ## Recommendations y' ELSE '' END AS after FROM conversations""",
)
def turn_checks(spark, sf):
    k = F.col("turn") % 4
    told = F.when(k == 0, " YES ").when(k == 1, "1").when(k == 2, "true").otherwise("no")
    cut = text.truncated(F.col("text"), 40)
    parted = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" ## Recommendations x ## Recommendations y "))).otherwise(F.coalesce(F.substring("text", 1, 20), F.lit("")))
    before, after = text.narrative(parted)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.parse_bool(told).alias("truth"), text.wait_seconds(F.col("text"), 2.5).alias("wait"), cut.alias("cut"), text.fill_template("Say: {{text}} {{other}}", text=cut).alias("prompt"), before.alias("before"), after.alias("after")
    )


@query("mentioned_factors", "SELECT incident_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN pif_{f} THEN '{f}' END" for f in FACTORS["work"]) + "], lambda x: x IS NOT NULL), ',') AS work, " + " + ".join(f"CAST({p} AS INTEGER)" for p in MODEL_PIFS) + " AS n_factors FROM incidents", INCIDENTS)
def mentioned_factors(spark, sf):
    return incidents(spark, sf).select("incident_id", F.array_join(F.map_keys(context.mentioned("work")), ",").alias("work"), cascade.factor_count(MODEL_PIFS).alias("n_factors"))


@query("json_cells", "SELECT incident_id, control_id, CASE WHEN control_seq % 3 = 0 THEN '[broken' ELSE '[\"' || array_to_string(linked_threat_ids, '\",\"') || '\"]' END AS cell, CASE WHEN control_seq % 3 = 0 THEN 0 ELSE len(linked_threat_ids) END AS n FROM controls", CONTROLS)
def json_cells(spark, sf):
    rows = context.json_cells(controls(spark, sf, named=False).select("incident_id", "control_id", "control_seq", F.col("linked_threat_ids").alias("cell")), ["cell"])
    broken = rows.withColumn("cell", F.when(F.col("control_seq") % 3 == 0, "[broken").otherwise(F.col("cell")))
    return context.json_lists(broken.withColumn("list", F.col("cell")), ["list"]).select("incident_id", "control_id", "cell", F.size("list").alias("n"))


@query("class_weights", f"SELECT count(*) FILTER (NOT y) / count(*) FILTER (y)::DOUBLE AS weight FROM (SELECT coalesce(barrier_status IN ({FAILED}), false) AS y FROM controls WHERE barrier_status IS DISTINCT FROM 'unknown')", CONTROLS)
def class_weights(spark, sf):
    return profiling.class_weight(profiling.labels(profiling.known(controls(spark, sf, named=False))), "label_barrier_failed")


@query("fold_summary", f"SELECT round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(mcc), 6) AS mcc_mean, round(stddev_pop(mcc), 6) AS mcc_std FROM (SELECT *, {_METRICS} FROM (SELECT fold, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y <> 1) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y <> 1) AS tn FROM scored JOIN folds USING (grp) GROUP BY 1))", _SCORED, _FOLDS)
def fold_summary(spark, sf):
    return metrics.fold_summary(metrics.binary_metrics(_dealt(spark, sf), ["fold"]), ["f1", "mcc"])


@query("fold_branch", "SELECT round(avg(auc), 6) AS mean_auc, min(auc) AS least_auc, CASE WHEN avg(auc) >= 0.70 AND min(auc) >= 0.60 THEN 'A' WHEN avg(auc) >= 0.60 AND min(auc) >= 0.55 THEN 'B' ELSE 'C' END AS branch FROM aucs", _SCORED, _FOLDS, _AUC)
def fold_branch(spark, sf):
    return metrics.branch(metrics.roc_auc(_dealt(spark, sf), ["fold"])).withColumn("mean_auc", F.round("mean_auc", 6))


_BY_FOLD = f"by_fold AS (SELECT fold, {{0}} AS k, {_METRICS} FROM (SELECT fold, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y <> 1) AS fp, count(*) FILTER (s < 0.5 AND y = 1) AS fn, count(*) FILTER (s < 0.5 AND y <> 1) AS tn FROM {{1}} GROUP BY 1))"
_FULL = _BY_FOLD.replace("by_fold", "full_fold", 1).format("0", "(SELECT fold, y, score AS s FROM scored JOIN folds USING (grp))")
_REDUCED = _BY_FOLD.replace("by_fold", "reduced_fold", 1).format("1", "(SELECT fold, y, 1 - score AS s FROM scored JOIN folds USING (grp))")


@query(
    "ablation",
    " UNION ALL ".join(f"SELECT '{m}' AS metric, round(f, 6) AS \"full\", round(r, 6) AS reduced, CASE WHEN f - r > 0.01 THEN 'improved' WHEN f - r < -0.01 THEN 'degraded' ELSE 'neutral' END AS impact FROM (SELECT (SELECT avg({m}) FROM full_fold) AS f, (SELECT avg({m}) FROM reduced_fold) AS r)" for m in ("f1", "mcc")),
    _SCORED,
    _FOLDS,
    _FULL,
    _REDUCED,
)
def ablation(spark, sf):
    rows = _dealt(spark, sf)
    reduced = metrics.binary_metrics(rows.withColumn("score", 1 - F.col("score")), ["fold"])
    found = ml.ablation(metrics.binary_metrics(rows, ["fold"]), reduced)
    return found.select("metric", F.round("full", 6).alias("full"), F.round("reduced", 6).alias("reduced"), "impact")


_TIERS = "CASE WHEN {0} >= 0.66 THEN 'HIGH' WHEN {0} >= 0.33 THEN 'MEDIUM' ELSE 'LOW' END"


@query("risk_tiers", f"SELECT incident_id, control_id, {_TIERS.format('p')} AS tier, CASE WHEN p >= 0.70 THEN 'red' WHEN p >= 0.45 THEN 'amber' ELSE 'green' END AS colour FROM scores WHERE p IS NOT NULL", CONTROLS, _SCORES)
def risk_tiers(spark, sf):
    p = F.col("p")
    return _scores(spark, sf).where("p is not null").select("incident_id", "control_id", cascade.tier(p).alias("tier"), cascade.colour(p).alias("colour"))


_CLASSES = ["HIGH", "MEDIUM", "LOW"]


@query(
    "class_report",
    """SELECT class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS f1, tp + fn AS support
    FROM (SELECT class, count(*) FILTER (y = class AND said = class) AS tp, count(*) FILTER (y <> class AND said = class) AS fp, count(*) FILTER (y = class AND said <> class) AS fn FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) AS v(class),
      (SELECT """ + _TIERS.format("p") + " AS y, " + _TIERS.format("(1 - p)") + " AS said FROM scores WHERE p IS NOT NULL) GROUP BY 1)",
    CONTROLS,
    _SCORES,
)
def class_report(spark, sf):
    rows = _scores(spark, sf).where("p is not null").select(cascade.tier(F.col("p")).alias("y"), cascade.tier(1 - F.col("p")).alias("predicted"))
    return metrics.per_class_metrics(rows, _CLASSES)


_RUNS = "runs AS (SELECT c.incident_id, c.control_id AS control_id_cond, t.control_id AS control_id_target, f AS feature, (c.quantity * (2 * i + 1) + t.quantity * (i + 3)) % 23 - 11 AS value FROM controls c JOIN controls t ON c.incident_id = t.incident_id AND c.control_seq <> t.control_seq, (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3)) AS v(f, i))"


@query(
    "reasons_of_worst",
    """SELECT incident_id, control_id, feature, value, n FROM (SELECT r.incident_id, r.control_id_target AS control_id, feature, value, CAST(row_number() OVER (PARTITION BY r.incident_id, r.control_id_target ORDER BY abs(value) DESC, feature) AS INTEGER) AS n
    FROM runs r JOIN (SELECT incident_id, control_id_target, arg_max(control_id_cond, (p, control_id_cond)) AS control_id_cond FROM pair_scores GROUP BY 1, 2) USING (incident_id, control_id_target, control_id_cond)) WHERE n <= 2""",
    CONTROLS,
    _PAIR_SCORES,
    _RUNS,
)
def reasons_of_worst(spark, sf):
    barriers = controls(spark, sf, named=False).select("incident_id", "control_seq", "control_id", "quantity")
    p = lambda c, t: ((c["quantity"] * 31 + t["quantity"] * 17) % 100) / F.lit(100.0)
    value = lambda c, t, i: (c["quantity"] * (2 * i + 1) + t["quantity"] * (i + 3)) % 23 - 11
    reasons = lambda c, t: F.array(*[F.struct(F.lit(f).alias("feature"), value(c, t, i).alias("value")) for i, f in enumerate("abcd")])
    return cascade.reasons_of_worst(barriers, p, reasons)


def _placed(rows):
    """A sorted result with each row's position in it."""
    return files.placed(rows, work_folder(rows.sparkSession, "order"), "position")


@query("coverage_order", "SELECT row_number() OVER (ORDER BY s, controls_total DESC, incident_id) - 1 AS position, incident_id, controls_total FROM (SELECT incident_id, count(*) AS controls_total, (count(*) FILTER (barrier_status = 'active') + 0.5::DOUBLE * count(*) FILTER (barrier_status = 'degraded')) / count(*) AS s FROM controls GROUP BY 1)", CONTROLS)
def coverage_order(spark, sf):
    return _placed(coverage.in_report_order(coverage.coverage(controls(spark, sf, named=False))).select("incident_id", "controls_total"))


@query("gap_order", "SELECT row_number() OVER (ORDER BY incident_id, barrier_status NULLS LAST, barrier_type, name, control_id) - 1 AS position, incident_id, control_id, barrier_status, name FROM gaps", CONTROLS, _GAPS)
def gap_order(spark, sf):
    rows = coverage.gaps(controls(spark, sf))
    ordered = rows.orderBy(*[F.asc_nulls_last(c) for c in ("incident_id", "barrier_status", "barrier_type", "name", "control_id")])
    assert coverage.in_gap_order(rows).columns == ordered.columns
    return _placed(ordered.select("incident_id", "control_id", "barrier_status", "name"))


@query("rollup_order", "SELECT row_number() OVER (ORDER BY rollup, gap_count DESC, value) - 1 AS position, rollup, value, gap_count FROM (SELECT 'by_barrier_type' AS rollup, barrier_type AS value, count(*) AS gap_count FROM gaps GROUP BY 2 UNION ALL SELECT 'by_side', side, count(*) FROM gaps GROUP BY 2)", CONTROLS, _GAPS)
def rollup_order(spark, sf):
    return _placed(coverage.in_rollup_order(coverage.gap_rollups(coverage.gaps(controls(spark, sf)), ["barrier_type", "side"])).select("rollup", "value", "gap_count"))


@query(
    "rule_order",
    """SELECT row_number() OVER (ORDER BY c DESC, l DESC, antecedent, consequent) - 1 AS position, antecedent, consequent FROM (SELECT antecedent, consequent, n / na::DOUBLE AS c, n * p / (na * nc)::DOUBLE AS l, n / p::DOUBLE AS s FROM (SELECT a AS antecedent, b AS consequent, n FROM pairs UNION ALL SELECT b, a, n FROM pairs)
      JOIN (SELECT item AS antecedent, count(*) AS na FROM items GROUP BY 1) USING (antecedent) JOIN (SELECT item AS consequent, count(*) AS nc FROM items GROUP BY 1) USING (consequent), (SELECT count(DISTINCT incident_id) AS p FROM items))
    WHERE s >= 0.005 AND c >= 0.08 AND l > 1""",
    CONTROLS,
    FAMILIES,
    ITEMS,
    PAIRS,
)
def rule_order(spark, sf):
    return _placed(mining.in_rule_order(mining.association_rules(_items(spark, sf), 0.005, 0.08)).select("antecedent", "consequent"))


@query("sorted_barriers", "SELECT row_number() OVER (ORDER BY lower(human_contribution_value) DESC NULLS LAST, incident_id, control_id) - 1 AS position, incident_id, control_id, human_contribution_value FROM controls WHERE side = 'mitigation' AND barrier_type = 'ppe'", CONTROLS)
def sorted_barriers(spark, sf):
    rows = cascade.filter_rows(controls(spark, sf, named=False), side="mitigation", barrier_type="ppe", line_of_defense=None)
    return _placed(cascade.sort_rows(rows, "human_contribution_value", True, "incident_id", "control_id").select("incident_id", "control_id", "human_contribution_value"))


@query("merged_scores", "SELECT control_id, a.p AS p_a, b.p AS p_b, coalesce(b.p, a.p) AS composite FROM (SELECT incident_id || control_id AS control_id, quantity / 100.0::DOUBLE AS p FROM controls) a LEFT JOIN (SELECT incident_id || control_id AS control_id, control_seq / 10.0::DOUBLE AS p FROM controls WHERE control_seq % 2 = 0) b USING (control_id)", CONTROLS)
def merged_scores(spark, sf):
    rows = controls(spark, sf, named=False).select(F.concat(F.col("incident_id").cast("string"), "control_id").alias("control_id"), "quantity", "control_seq")
    a = rows.select("control_id", (F.col("quantity") / F.lit(100.0)).alias("p"))
    b = rows.where("control_seq % 2 = 0").select("control_id", (F.col("control_seq") / F.lit(10.0)).alias("p"))
    merged = cascade.merge_scores(a, b)
    ranks = b.withColumnRenamed("p", "composite")
    return cascade.with_rank_fallback(a, ranks).select("control_id", "composite").join(merged, "control_id")


@query("first_links", "SELECT href, page_id FROM (SELECT href, page_id, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS n FROM (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1) AS h FROM pages))) WHERE n = 1")
def first_links(spark, sf):
    return html.first_seen(html.links(table(spark, sf, "pages")), "href", "page_id", "pos").select("href", "page_id")


@query("rejected_rows", "SELECT incident_id, control_id, CASE WHEN barrier_status IS NULL THEN 'barrier_status: null' ELSE 'barrier_status: ' || barrier_status END AS reason FROM controls WHERE barrier_status IS NULL OR barrier_status NOT IN ('active', 'failed')", CONTROLS)
def rejected_rows(spark, sf):
    _, bad = profiling.reject(controls(spark, sf, named=False), "barrier_status", ["active", "failed"])
    return bad.select("incident_id", "control_id", "reason")


@query("rows_in_scope", "SELECT incident_id, control_id FROM controls WHERE incident_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND barrier_status IS NOT NULL AND supporting_text_count IS NOT NULL", CONTROLS)
def rows_in_scope(spark, sf):
    scope = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("incident_id"))
    return profiling.in_scope(cascade.complete(controls(spark, sf, named=False), ["barrier_status", "supporting_text_count"]), scope).select("incident_id", "control_id")


@query("checked_join", "SELECT incident_id, control_id, pif_training FROM controls JOIN incidents USING (incident_id)", CONTROLS, INCIDENTS)
def checked_join(spark, sf):
    """The join of barriers to their incidents that must neither add rows nor leave any without a match."""
    return profiling.left_join_checked(controls(spark, sf, named=False).select("incident_id", "control_id"), incidents(spark, sf).select("incident_id", "pif_training"), "incident_id")


@query("inconsistent_incidents", "SELECT incident_id FROM controls GROUP BY 1 HAVING count(DISTINCT side) > 1 OR count(DISTINCT barrier_type) > 1", CONTROLS)
def inconsistent_incidents(spark, sf):
    return metrics.inconsistent(controls(spark, sf, named=False), "incident_id", ["side", "barrier_type"]).select("incident_id")


@query("metadata_fallback", "SELECT h.incident_id, h.control_id, CASE WHEN h.incident_id % 2 = 0 THEN m.confidence ELSE f.confidence END AS confidence FROM controls h LEFT JOIN controls m ON m.incident_id = h.incident_id AND m.control_id = h.control_id LEFT JOIN (SELECT control_id, arg_min(confidence, incident_id) AS confidence FROM controls WHERE incident_id % 2 = 0 GROUP BY 1) f ON f.control_id = h.control_id", CONTROLS)
def metadata_fallback(spark, sf):
    rows = controls(spark, sf, named=False).select("incident_id", "control_id", "confidence")
    return retrieval.with_metadata(rows.select("incident_id", "control_id"), rows.where("incident_id % 2 = 0"), ["confidence"])


@query("citations", "SELECT incident_id, control_id, CASE WHEN supporting_text_count > 0 THEN substr(repeat('q', 497) || control_id, 1, 500) ELSE '' END AS citation FROM controls", CONTROLS)
def citations(spark, sf):
    quotes = F.when(F.col("supporting_text_count") > 0, F.array(F.concat(F.repeat(F.lit("q"), F.lit(497)), "control_id"), F.lit("second")))
    return retrieval.citations(controls(spark, sf, named=False).withColumn("supporting_text", quotes)).select("incident_id", "control_id", "citation")

"""Queries over manifests, barrier pairs, scenarios, threats and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions.vocabulary import FACTORS, MODEL_PIFS, PIFS
from ..operators import cascade, context, manifests, taxonomy, threats as threat_ops
from .adapters import CONTROLS, INCIDENTS, THREATS, controls, incidents, threats
from .registry import query, table


def _manifest(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    rows = e.select(
        F.lit("evt").alias("source"),
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("incident_id"),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 97).cast("string"))).alias("pdf_url"),
        (F.col("event_type") == "purchase").alias("downloaded"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("ts")).alias("retrieved_at"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("sha256"),
        F.when(k % 7 == 0, F.lit(None).cast("long")).otherwise(F.floor(F.col("value") * 100).cast("long")).alias("file_size_bytes"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("title "), k.cast("string"))).alias("title"),
        F.when(k % 3 > 0, F.lit(None).cast("string")).otherwise(k.cast("string")).alias("pdf_path"),
        k.alias("row_order"),
    )
    return rows.where("row_order % 2 = 0"), rows.where("row_order % 2 = 1")


_MANIFEST = """m AS (SELECT 'evt' AS source, 'e' || user_id AS incident_id, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'u' || (user_id % 97) END AS pdf_url, event_type = 'purchase' AS downloaded,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS retrieved_at, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'h' || event_id END AS sha256,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS file_size_bytes, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'title ' || event_id END AS title,
  CASE WHEN event_id % 3 > 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS pdf_path, event_id AS row_order FROM events)"""


@query(
    "manifest_merge",
    """SELECT source, w.incident_id, w.pdf_url, w.downloaded, epoch_us(w.retrieved_at) AS retrieved_us, w.sha256, w.file_size_bytes, title, pdf_path, w.row_order FROM (
      SELECT source, arg_min(struct_pack(incident_id, pdf_url, downloaded, retrieved_at, sha256, file_size_bytes, row_order), n) AS w, arg_min(title, n) FILTER (title <> '') AS title, arg_min(pdf_path, n) FILTER (pdf_path IS NOT NULL) AS pdf_path FROM (
        SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY downloaded DESC, retrieved_at DESC NULLS LAST, (sha256 <> '') DESC, file_size_bytes DESC NULLS LAST, row_order % 2, incident_id, row_order) AS n
        FROM (SELECT *, CASE WHEN pdf_url <> '' THEN 'u:' || pdf_url ELSE 'i:' || incident_id END AS key FROM m)) GROUP BY source, key)""",
    _MANIFEST,
)
def manifest_merge(spark, sf):
    merged = manifests.merge(*_manifest(spark, sf))
    return merged.select("source", "incident_id", "pdf_url", "downloaded", F.unix_micros(F.col("retrieved_at").cast("timestamp")).alias("retrieved_us"), "sha256", "file_size_bytes", "title", "pdf_path", "row_order")


@query("manifest_upsert", "SELECT incident_id, title, row_order FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY row_order % 2 DESC, row_order DESC) AS n FROM m) WHERE n = 1", _MANIFEST)
def manifest_upsert(spark, sf):
    return manifests.upsert(*_manifest(spark, sf), "incident_id").select("incident_id", "title", "row_order")


@query("resume_pending", "SELECT row_order, incident_id FROM m WHERE row_order % 2 = 1 AND incident_id NOT IN (SELECT incident_id FROM m WHERE row_order % 2 = 0 AND downloaded)", _MANIFEST)
def resume_pending(spark, sf):
    existing, new = _manifest(spark, sf)
    return manifests.pending(new, existing.where("downloaded"), "incident_id").select("row_order", "incident_id")


def _stems(spark, sf):
    """All documents, the forms, of which every eleventh has an id without a document, and the documents of one source."""
    stem = lambda c: F.concat(F.lit("d"), c.cast("string")).alias("stem")
    docs, known, key = table(spark, sf, "documents"), table(spark, sf, "labels"), F.col("doc_id")
    shifted = F.when(key % 11 == 0, key + 10_000_000).otherwise(key)
    return docs.select(stem(key)), known.select(stem(shifted)), docs.where("source = 'src3'").select(stem(key))


_STEMS = """pdfs AS (SELECT DISTINCT 'd' || doc_id AS stem FROM documents), forms AS (SELECT DISTINCT 'd' || CASE WHEN doc_id % 11 = 0 THEN doc_id + 10000000 ELSE doc_id END AS stem FROM labels),
 marked AS (SELECT DISTINCT 'd' || doc_id AS stem FROM documents WHERE source = 'src3')"""


@query("corpus_manifest", "SELECT stem, CASE WHEN stem IN (SELECT stem FROM forms) THEN 'ready' ELSE 'needs_extraction' END AS status, stem IN (SELECT stem FROM marked) AS flagged FROM pdfs", _STEMS)
def corpus_manifest(spark, sf):
    return manifests.corpus(*_stems(spark, sf))


@query("noise_docs", "SELECT stem FROM forms WHERE stem NOT IN (SELECT stem FROM pdfs)", _STEMS)
def noise_docs(spark, sf):
    pdfs, forms, _ = _stems(spark, sf)
    return manifests.noise(forms, pdfs)


@query(
    "barrier_pairs",
    """SELECT c.incident_id, c.control_id AS control_id_cond, t.control_id AS control_id_target, c.lod_numeric AS lod_numeric_cond, t.lod_numeric AS lod_numeric_target, CAST(t.barrier_failed AS INTEGER) AS y_fail_target
    FROM controls c JOIN controls t USING (incident_id) WHERE c.barrier_failed AND c.control_seq <> t.control_seq""",
    CONTROLS,
)
def barrier_pairs(spark, sf):
    rows = controls(spark, sf, named=False).select("incident_id", "control_seq", "control_id", "lod_numeric", F.col("barrier_failed").cast("int").alias("y_fail"))
    pairs = cascade.barrier_pairs(rows, ["control_seq"], keep=["control_id", "lod_numeric", "y_fail"])
    return pairs.select("incident_id", "control_id_cond", "control_id_target", "lod_numeric_cond", "lod_numeric_target", "y_fail_target")


_STATS = """line_threats AS (SELECT incident_id, lod_numeric, CAST(count(DISTINCT t) AS INTEGER) AS num_threats_in_lod_numeric FROM (SELECT incident_id, lod_numeric, unnest(linked_threat_ids) AS t FROM controls) GROUP BY 1, 2),
 stats AS (SELECT incident_id, control_id, control_seq, lod_numeric, line_of_defense, side, CAST(control_seq - 1 AS INTEGER) AS pathway_sequence, count(*) FILTER (side = 'prevention') OVER (PARTITION BY incident_id) AS total_prev,
  count(*) FILTER (side = 'mitigation') OVER (PARTITION BY incident_id) AS total_mit, num_threats_in_lod_numeric FROM controls JOIN line_threats USING (incident_id, lod_numeric))"""


@query("scenario_stats", "SELECT incident_id, control_id, pathway_sequence, total_prev, total_mit, num_threats_in_lod_numeric FROM stats", CONTROLS, _STATS)
def scenario_stats(spark, sf):
    return cascade.scenario_stats(controls(spark, sf, named=False)).select("incident_id", "control_id", "pathway_sequence", "total_prev", "total_mit", "num_threats_in_lod_numeric")


_FLAG_NAMES = [(name, "|".join(words), factor) for name, (words, factor) in cascade.FLAGS.items()]
_SIDE_COLUMNS = {"line_of_defense": "lod_industry_standard", "side": "barrier_level", "pathway_sequence": "pathway_sequence", "CAST(@lod_numeric AS DOUBLE)": "lod_numeric", "num_threats_in_lod_numeric": "num_threats_in_lod_numeric"}
_NAMED = "named AS (SELECT incident_id, threat_id, CASE threat_id WHEN 'T-001' THEN 'Pump leak' WHEN 'T-002' THEN 'Operator error' ELSE 'Loss of power' END AS threat_name FROM threats)"
_SCENARIO = f"""per_incident AS (SELECT incident_id, count(*) AS num_threats_in_sequence, string_agg(threat_name, ' ') AS txt FROM named GROUP BY 1),
 features AS (SELECT c.incident_id, c.control_id AS control_id_cond, t.control_id AS control_id_target, 'ineffective' AS barrier_condition_cond, t.total_prev AS total_prev_barriers_incident, t.total_mit AS total_mit_barriers_incident,
  {", ".join((old.replace("@", f"{x}.") if "@" in old else f"{x}.{old}") + f" AS {new}_{side}" for x, side in (("c", "cond"), ("t", "target")) for old, new in _SIDE_COLUMNS.items())}, coalesce(num_threats_in_sequence, 0) AS num_threats_in_sequence,
  {", ".join(f"CAST(coalesce(regexp_matches(lower(txt), '{p}'), false)" + (f" OR {f}" if f else "") + f" AS INTEGER) AS {n}" for n, p, f in _FLAG_NAMES)}
  FROM stats c JOIN stats t ON c.incident_id = t.incident_id AND c.control_seq <> t.control_seq LEFT JOIN per_incident p ON p.incident_id = c.incident_id JOIN incidents i ON i.incident_id = c.incident_id)"""


@query("scenario_features", "SELECT * FROM features", CONTROLS, INCIDENTS, THREATS, _STATS, _NAMED, _SCENARIO)
def scenario_features(spark, sf):
    named = threats(spark, sf).withColumn("threat_name", F.when(F.col("threat_id") == "T-001", "Pump leak").when(F.col("threat_id") == "T-002", "Operator error").otherwise("Loss of power"))
    factors = incidents(spark, sf).select("incident_id", "pif_procedures", "pif_tools_equipment")
    return cascade.scenario_features(controls(spark, sf, named=False), named, factors)


_TRAINING = """training AS (SELECT incident_id, control_seq, CASE WHEN quantity = 7 THEN NULL ELSE line_of_defense END AS lod_industry_standard, side AS barrier_level, barrier_status AS barrier_condition, control_seq AS pathway_sequence, lod_numeric,
  supporting_text_count AS num_threats_in_lod_numeric, 1 AS total_prev_barriers_incident, 2 AS total_mit_barriers_incident, quantity AS num_threats_in_sequence, 0 AS flag_environmental_threat, 1 AS flag_electrical_failure, quantity % 2 AS flag_procedural_error,
  CASE WHEN quantity = 9 THEN 'NaN'::DOUBLE ELSE 0.5 END AS flag_mechanical_failure, CAST(barrier_failed AS INTEGER) AS y_fail, CAST(barrier_failed AND barrier_failed_human AS INTEGER) AS y_hf_fail FROM controls),
 clean AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY control_seq) AS k FROM training WHERE lod_industry_standard IS NOT NULL AND barrier_condition IS NOT NULL AND NOT isnan(flag_mechanical_failure))"""


@query(
    "pair_dataset",
    f"""SELECT t.incident_id, {", ".join(f"t.{c} AS {c}_target" for c in cascade.TARGET_FEATURES)}, {", ".join(f"c.{c} AS {c}_cond" for c in cascade.CONDITION_FEATURES)}, {", ".join(f"t.{c}" for c in cascade.CONTEXT_FEATURES)},
    {", ".join(f"{x}.{y} AS {y}_{side}" for x, side in (("t", "target"), ("c", "cond")) for y in cascade.TARGETS)} FROM clean t JOIN clean c ON t.incident_id = c.incident_id AND t.k <> c.k WHERE c.y_fail = 1""",
    CONTROLS,
    _TRAINING,
)
def pair_dataset(spark, sf):
    q, failed = F.col("quantity"), F.col("barrier_failed")
    rows = controls(spark, sf, named=False).select(
        "incident_id", "control_seq", F.when(q != 7, F.col("line_of_defense")).alias("lod_industry_standard"), F.col("side").alias("barrier_level"), F.col("barrier_status").alias("barrier_condition"), F.col("control_seq").alias("pathway_sequence"), "lod_numeric",
        F.col("supporting_text_count").alias("num_threats_in_lod_numeric"), F.lit(1).alias("total_prev_barriers_incident"), F.lit(2).alias("total_mit_barriers_incident"), q.alias("num_threats_in_sequence"), F.lit(0).alias("flag_environmental_threat"),
        F.lit(1).alias("flag_electrical_failure"), (q % 2).alias("flag_procedural_error"), F.when(q == 9, float("nan")).otherwise(0.5).alias("flag_mechanical_failure"), failed.cast("int").alias("y_fail"), (failed & F.col("barrier_failed_human")).cast("int").alias("y_hf_fail"),
    )
    return cascade.pair_dataset(rows, ["control_seq"])


_PAIR_SCORES = "pair_scores AS (SELECT c.incident_id, c.control_id AS control_id_cond, t.control_id AS control_id_target, ((c.quantity * 31 + t.quantity * 17) % 100) / 100.0::DOUBLE AS p FROM controls c JOIN controls t ON c.incident_id = t.incident_id AND c.control_seq <> t.control_seq)"
_SCORES = "scores AS (SELECT incident_id, control_id, side, CASE WHEN quantity % 10 = 0 THEN NULL ELSE ((quantity * 37 + control_seq * 11) % 100) / 100.0::DOUBLE END AS p FROM controls)"


def _pair_scores(spark, sf):
    rows = controls(spark, sf, named=False).select("incident_id", "control_seq", "control_id", "quantity", F.lit(1).alias("y_fail"))
    pairs = cascade.barrier_pairs(rows, ["control_seq"], keep=["control_id", "quantity"])
    return pairs.withColumn("p", ((F.col("quantity_cond") * 31 + F.col("quantity_target") * 17) % 100) / F.lit(100.0))


def _scores(spark, sf):
    p = ((F.col("quantity") * 37 + F.col("control_seq") * 11) % 100) / F.lit(100.0)
    return controls(spark, sf, named=False).select("incident_id", "control_id", "side", F.when(F.col("quantity") % 10 != 0, p).alias("p"))


@query("cascade_average", "SELECT incident_id, control_id_target, round(avg(p), 6) AS average, arg_max(control_id_cond, (p, control_id_cond)) AS worst_cond, max(p) AS worst FROM pair_scores GROUP BY 1, 2", CONTROLS, _PAIR_SCORES)
def cascade_average(spark, sf):
    return cascade.cascade_average(_pair_scores(spark, sf))


@query("top_at_risk", "SELECT incident_id, control_id, p FROM scores WHERE p IS NOT NULL ORDER BY p DESC, incident_id, control_id LIMIT 10", CONTROLS, _SCORES)
def top_at_risk(spark, sf):
    return _scores(spark, sf).where("p is not null").select("incident_id", "control_id", "p").orderBy(F.desc("p"), "incident_id", "control_id").limit(10)


@query(
    "ranked_barriers",
    """SELECT incident_id, control_id, p, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY p DESC, control_id) AS INTEGER) AS place, CAST(rank() OVER (PARTITION BY incident_id ORDER BY p DESC) AS INTEGER) AS rank,
    CASE WHEN p >= 0.70 THEN 'HIGH' WHEN p >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM scores WHERE p IS NOT NULL""",
    CONTROLS,
    _SCORES,
)
def ranked_barriers(spark, sf):
    rows = _scores(spark, sf).where("p is not null").select("incident_id", "control_id", "p")
    return cascade.ranked(rows, "p").withColumn("band", cascade.risk_band(F.col("p")))


@query("risk_distribution", "SELECT count(*) FILTER (p >= 0.70) AS high, count(*) FILTER (p >= 0.45 AND p < 0.70) AS medium, count(*) FILTER (p < 0.45) AS low FROM scores", CONTROLS, _SCORES)
def risk_distribution(spark, sf):
    return cascade.risk_distribution(_scores(spark, sf), "p")


_FEATURES = ["pif_competence", "pif_procedures", "pif_training", "lod", "side", "text"]


def _contributions(spark, sf):
    value = lambda k: (F.col("quantity") * (2 * k + 1) + F.col("control_seq") * (k + 3)) % 23 - 11
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(int(f.startswith("pif"))).alias("is_context"), value(k).alias("value")) for k, f in enumerate(_FEATURES)])).alias("c")
    return controls(spark, sf, named=False).select("incident_id", "control_id", "quantity", "control_seq", rows).select("incident_id", "control_id", "c.*")


_CONTRIBUTIONS = "contributions AS (" + " UNION ALL ".join(f"SELECT incident_id, control_id, '{f}' AS feature, {int(f.startswith('pif'))} AS is_context, (quantity * {2 * k + 1} + control_seq * {k + 3}) % 23 - 11 AS value FROM controls" for k, f in enumerate(_FEATURES)) + ")"
_TOP = "top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, control_id ORDER BY abs(value) DESC, feature) AS n FROM contributions) WHERE n <= 3)"


@query("shap_mean_abs", "SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM contributions GROUP BY 1", CONTROLS, _CONTRIBUTIONS)
def shap_mean_abs(spark, sf):
    return cascade.mean_absolute(_contributions(spark, sf))


@query(
    "pif_prevalence",
    f"SELECT f AS feature, (SELECT count(*) FROM top3 WHERE feature = f) / (SELECT count(*) FROM controls)::DOUBLE AS share FROM (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in MODEL_PIFS)}) AS v(f)",
    CONTROLS,
    _CONTRIBUTIONS,
    _TOP,
)
def pif_prevalence(spark, sf):
    return cascade.factor_prevalence(_contributions(spark, sf), MODEL_PIFS)


@query("context_prevalence", "SELECT f AS feature, (SELECT count(*) FROM top3 WHERE feature = f) / (SELECT count(*) FROM controls)::DOUBLE AS share FROM (VALUES ('lod'), ('side'), ('text')) AS v(f)", CONTROLS, _CONTRIBUTIONS, _TOP)
def context_prevalence(spark, sf):
    return cascade.factor_prevalence(_contributions(spark, sf), ["lod", "side", "text"])


@query(
    "shap_waterfall",
    """SELECT incident_id, control_id, feature, is_context, value, CAST(row_number() OVER w AS INTEGER) AS pos, CAST(coalesce(sum(value) OVER (PARTITION BY incident_id, control_id ORDER BY is_context, abs(value) DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
    FROM top3 WINDOW w AS (PARTITION BY incident_id, control_id ORDER BY is_context, abs(value) DESC, feature)""",
    CONTROLS,
    _CONTRIBUTIONS,
    _TOP,
)
def shap_waterfall(spark, sf):
    return cascade.waterfall(_contributions(spark, sf), 3)


def _threat_sources(spark, sf):
    """Incidents with their threats in order; some documents are absent, some cannot be read, some have no top event."""
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    ids = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("o_custkey") % 4).cast("int")), lambda k: F.concat(F.lit("T-00"), k.cast("string")))
    threats_ = F.when(F.col("o_custkey") % 4 > 0, F.transform(ids, lambda t: F.struct(t.alias("threat_id"), F.concat(F.lit("threat "), t).alias("threat_name"))))
    blank = lambda p, c: F.when(key % p == 0, "").otherwise(c)
    return orders.where(key % 23 != 1).select(
        key.alias("incident_id"), threats_.alias("threats"), blank(2, F.col("o_orderpriority")).alias("top_event"), blank(3, F.lit("described")).alias("description"),
        blank(5, F.col("o_orderstatus")).alias("incident_type"), F.when(key % 29 == 2, "cut off").alias("error"),
    )


_THREAT_PAIRS = """docs AS (SELECT o_orderkey AS incident_id, o_custkey % 4 AS n, o_orderkey % 29 = 2 AS bad, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority WHEN o_orderkey % 3 <> 0 THEN 'described' WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'Loss of Containment' END AS top
   FROM orders WHERE o_orderkey % 23 <> 1),
 good AS (SELECT c.incident_id, control_seq, linked_threat_ids, n, top FROM controls c JOIN docs d USING (incident_id) WHERE NOT bad),
 explicit AS (SELECT incident_id, control_seq, t AS threat_id FROM (SELECT incident_id, control_seq, n, unnest(linked_threat_ids) AS t FROM good) WHERE CAST(substr(t, 5) AS INTEGER) BETWEEN 1 AND n),
 rest AS (SELECT * FROM good ANTI JOIN explicit USING (incident_id, control_seq)),
 threat_pairs AS (SELECT incident_id, control_seq, threat_id, 'threat ' || threat_id AS threat_name, 'explicit' AS mapping_method FROM explicit
  UNION ALL SELECT incident_id, control_seq, 'T-00' || k, 'threat T-00' || k, 'side_inferred' FROM rest, (VALUES (1), (2), (3)) AS v(k) WHERE k <= n
  UNION ALL SELECT incident_id, control_seq, 'T-TOP', top, 'top_event_only' FROM rest WHERE n = 0
  UNION ALL SELECT incident_id, control_seq, 'T-ERROR', 'Error loading JSON: cut off', 'json_error' FROM controls JOIN docs USING (incident_id) WHERE bad
  UNION ALL SELECT incident_id, control_seq, 'T-UNKNOWN', 'Unknown (JSON not found)', 'json_missing' FROM controls ANTI JOIN docs USING (incident_id))"""


def _threat_pairs(spark, sf):
    return threat_ops.threat_barrier_pairs(controls(spark, sf, named=False), _threat_sources(spark, sf))


@query("threat_barrier_pairs", "SELECT * FROM threat_pairs", CONTROLS, _THREAT_PAIRS)
def threat_barrier_pairs(spark, sf):
    return _threat_pairs(spark, sf)


@query("threat_pair_stats", "SELECT mapping_method, count(*) AS pairs, count(DISTINCT incident_id) AS incidents FROM threat_pairs GROUP BY 1", CONTROLS, _THREAT_PAIRS)
def threat_pair_stats(spark, sf):
    return threat_ops.pair_stats(_threat_pairs(spark, sf))


@query("threat_coverage_check", "SELECT count(*) AS uncovered FROM controls ANTI JOIN threat_pairs USING (incident_id, control_seq)", CONTROLS, _THREAT_PAIRS)
def threat_coverage_check(spark, sf):
    return threat_ops.uncovered(controls(spark, sf, named=False), _threat_pairs(spark, sf)).agg(F.count("*").alias("uncovered"))


@query(
    "line_lookup",
    "SELECT incident_id, 'P-' || k AS control_id, arg_max(line_of_defense, control_seq) AS lod_industry_standard, arg_max(lod_numeric, control_seq) AS lod_numeric FROM (SELECT incident_id, control_seq, line_of_defense, lod_numeric, quantity % 3 AS k FROM controls) GROUP BY 1, 2",
    CONTROLS,
)
def line_lookup(spark, sf):
    """Controls are named by a few values, so that ids repeat in an incident and the last row counts."""
    named = F.concat(F.lit("P-"), (F.col("quantity") % 3).cast("string"))
    base = controls(spark, sf, named=False).select("incident_id", "control_seq", named.alias("control_id"), F.col("line_of_defense").alias("lod_industry_standard"), "lod_numeric")
    return threat_ops.line_lookup(base, "control_seq")


@query(
    "agency_lookup",
    """SELECT DISTINCT c.incident_id, CASE WHEN f.a IN ('BSEE', 'CSB') THEN f.a ELSE 'UNKNOWN' END AS source_agency FROM controls c
    LEFT JOIN (SELECT o_custkey AS incident_id, arg_min(CASE o_orderkey % 4 WHEN 0 THEN 'BSEE' WHEN 1 THEN 'CSB' ELSE 'NTSB' END, o_orderkey) AS a FROM orders GROUP BY 1) f USING (incident_id)""",
    CONTROLS,
)
def agency_lookup(spark, sf):
    k = F.col("o_orderkey") % 4
    flat = table(spark, sf, "orders").select(F.col("o_custkey").alias("incident_id"), "o_orderkey", F.when(k == 0, "BSEE").when(k == 1, "CSB").otherwise("NTSB").alias("source_agency"))
    return threat_ops.agency_lookup(controls(spark, sf, named=False), flat, ["BSEE", "CSB"], "o_orderkey")


_ELIGIBLE = """lod_rows AS (SELECT *, CASE WHEN line_of_defense = 'recovery' THEN 'Other' ELSE line_of_defense END AS lod_name FROM controls),
 counted AS (SELECT incident_id, count(*) AS n, count(*) FILTER (lod_numeric <> 99 AND lod_name <> 'Other') AS valid, count(*) FILTER (lod_numeric <> 99 AND lod_name <> 'Other' AND side = 'prevention') AS prev,
  count(*) FILTER (lod_numeric <> 99 AND lod_name <> 'Other' AND side = 'mitigation') AS mit FROM lod_rows GROUP BY 1),
 eligible AS (SELECT incident_id, valid, CASE WHEN n < 4 THEN 'too_few_controls' WHEN valid < 4 THEN 'too_few_valid' WHEN prev = 0 THEN 'no_prevention' WHEN mit = 0 THEN 'no_mitigation' ELSE '' END AS reason FROM counted)"""


def _eligible(spark, sf):
    return cascade.eligibility(controls(spark, sf, named=False).withColumn("lod_name", F.when(F.col("line_of_defense") == "recovery", "Other").otherwise(F.col("line_of_defense"))))


@query("scenario_eligibility", "SELECT * FROM eligible", CONTROLS, _ELIGIBLE)
def scenario_eligibility(spark, sf):
    return _eligible(spark, sf)


@query(
    "scenario_pick",
    """SELECT incident_id, source_agency, preferred FROM (SELECT *, row_number() OVER (PARTITION BY source_agency ORDER BY preferred DESC, incident_id) AS n FROM (
      SELECT incident_id, coalesce(region, 'UNKNOWN') AS source_agency, top_event = '1-URGENT' AND pif_training AS preferred FROM eligible JOIN incidents USING (incident_id) WHERE reason = '')) WHERE n = 1""",
    CONTROLS,
    INCIDENTS,
    _ELIGIBLE,
)
def scenario_pick(spark, sf):
    rows = incidents(spark, sf).select("incident_id", F.coalesce("region", F.lit("UNKNOWN")).alias("source_agency"), ((F.col("top_event") == "1-URGENT") & F.col("pif_training")).alias("preferred"))
    return cascade.pick_per_agency(_eligible(spark, sf).join(rows, "incident_id")).select("incident_id", "source_agency", "preferred")


def _valued(spark, sf):
    """Incidents with a value for each factor: negative, another note, blank or none."""
    key = F.col("incident_id")
    value = F.when(key % 3 == 0, "negative").when(key % 3 == 1, F.concat(F.lit(" noted "), (key % 5).cast("string"), F.lit(" "))).otherwise(" ")
    return incidents(spark, sf).withColumns({f"{p}_value": F.when(F.col(p), value) for p in PIFS})


_FACTOR = "CASE WHEN {p} THEN CASE incident_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN ' noted ' || (incident_id % 5) || ' ' ELSE ' ' END END"
_VALUED = f"valued AS (SELECT *, {', '.join(_FACTOR.format(p=p) + f' AS {p}_value' for p in PIFS)} FROM incidents)"


def _tags_sql(category: str) -> str:
    listed = ", ".join(f"CASE WHEN pif_{f}_value = 'negative' THEN '{f}' END" for f in FACTORS[category])
    return f"SELECT region, '{category}' AS category, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT region, unnest([{listed}]) AS t FROM valued) WHERE t IS NOT NULL GROUP BY 1"


@query("negative_pif_tags", " UNION ALL ".join(map(_tags_sql, FACTORS)), INCIDENTS, _VALUED)
def negative_pif_tags(spark, sf):
    tags = context.factor_tags(_valued(spark, sf), ["region"])
    return tags.withColumn("tags", F.array_join("tags", ","))


@query(
    "ordered_recommendations",
    """SELECT region, string_agg(rec, '|' ORDER BY n) AS recommendations FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY first_at) AS n FROM (
      SELECT region, operator AS rec, min(incident_id) AS first_at FROM incidents GROUP BY 1, 2)) WHERE n <= 5 GROUP BY 1""",
    INCIDENTS,
)
def ordered_recommendations(spark, sf):
    rows = incidents(spark, sf).select("region", F.col("incident_id").alias("pos"), F.array(F.lit(" "), F.concat(F.lit(" "), "operator")).alias("recommendations"))
    return context.ordered_recommendations(rows, ["region"]).withColumn("recommendations", F.array_join("recommendations", "|"))


@query("barrier_conditions", "SELECT incident_id, control_id, CASE barrier_status WHEN 'active' THEN 'effective' WHEN 'degraded' THEN 'degraded' WHEN 'unknown' THEN 'status_unknown' ELSE coalesce(CASE WHEN barrier_status IS NOT NULL THEN 'ineffective' END, 'status_unknown') END AS condition FROM controls", CONTROLS)
def barrier_conditions(spark, sf):
    return controls(spark, sf, named=False).select("incident_id", "control_id", context.condition(F.col("barrier_status")).alias("condition"))


_DISPLAY = {"engineering": "Engineered", "administrative": "Procedural", "1st": "First line"}


@query("display_names", "SELECT incident_id, control_id, CASE barrier_type WHEN 'engineering' THEN 'Engineered' WHEN 'administrative' THEN 'Procedural' ELSE barrier_type END AS barrier_type_display, CASE line_of_defense WHEN '1st' THEN 'First line' ELSE line_of_defense END AS line_of_defense_display FROM controls", CONTROLS)
def display_names(spark, sf):
    names = spark.createDataFrame(list(_DISPLAY.items()), "raw string, display string")
    rows = context.display_names(context.display_names(controls(spark, sf, named=False), "barrier_type", names), "line_of_defense", names)
    return rows.select("incident_id", "control_id", "barrier_type_display", "line_of_defense_display")


_NOTES = "list_filter([" + ", ".join(f"nullif(trim({p}_value), '')" for p in PIFS) + "], lambda x: x IS NOT NULL)"


@query("factor_notes", f"SELECT incident_id, coalesce(array_to_string({_NOTES}, '|'), '') AS notes FROM valued", INCIDENTS, _VALUED)
def factor_notes(spark, sf):
    return _valued(spark, sf).select("incident_id", F.array_join(context.factor_notes(), "|").alias("notes"))


_DESCRIBED = """described AS (SELECT *, CASE WHEN incident_id % 4 = 0 THEN NULL ELSE ['crude oil', 'gas'] END AS materials, CASE WHEN incident_id % 6 = 0 THEN ['inspect', 'train "all"'] ELSE [] END AS recommendations,
  CASE WHEN incident_id % 7 = 0 THEN NULL ELSE 'summary ' || incident_id END AS summary FROM valued)"""


def _described(spark, sf):
    key, none = F.col("incident_id"), F.array().cast("array<string>")
    return _valued(spark, sf).withColumns(
        {
            "materials": F.when(key % 4 != 0, F.array(F.lit("crude oil"), F.lit("gas"))),
            "recommendations": F.when(key % 6 == 0, F.array(F.lit("inspect"), F.lit('train "all"'))).otherwise(none),
            "summary": F.when(key % 7 != 0, F.concat(F.lit("summary "), key.cast("string"))),
        }
    )


def _one_tag(category: str) -> str:
    listed = ", ".join(f"CASE WHEN pif_{f}_value = 'negative' THEN '{f}' END" for f in sorted(FACTORS[category]))
    found = f"list_filter([{listed}], lambda x: x IS NOT NULL)"
    return f"""CASE WHEN len({found}) > 0 THEN '"{category}":["' || array_to_string({found}, '","') || '"]' END"""


_TAGS_JSON = "list_filter([" + ", ".join(map(_one_tag, FACTORS)) + "], lambda x: x IS NOT NULL)"


@query(
    "incident_documents",
    f"""SELECT incident_id, 'Top Event: ' || top_event || '\nIncident Type: ' || incident_type || '\nOperating Phase: unknown\nMaterials: ' || coalesce(array_to_string(materials, ', '), 'N/A') || '\nSummary: ' || coalesce(summary, '')
      || '\nRecommendations:\n' || CASE WHEN len(recommendations) > 0 THEN array_to_string(recommendations, '\n') ELSE 'N/A' END || '\nPerformance-Influencing Factor Notes:\n' || CASE WHEN len(notes) > 0 THEN array_to_string(notes, '\n') ELSE 'N/A' END AS incident_embed_text,
      top_event, incident_type, 'unknown' AS operating_phase, CASE WHEN materials IS NULL THEN '[]' ELSE '["crude oil","gas"]' END AS materials, coalesce(region, 'unknown') AS region, coalesce(operator, 'unknown') AS operator, coalesce(summary, '') AS summary,
      CASE WHEN len(recommendations) > 0 THEN '["inspect","train \\"all\\""]' ELSE '[]' END AS recommendations, CASE WHEN len(tags) > 0 THEN '{{' || array_to_string(tags, ',') || '}}' END AS pif_tags_json
    FROM (SELECT *, {_NOTES} AS notes, {_TAGS_JSON} AS tags FROM described)""",
    INCIDENTS,
    _VALUED,
    _DESCRIBED,
)
def incident_documents(spark, sf):
    return context.incident_documents(_described(spark, sf))


@query(
    "barrier_documents",
    f"""SELECT c.incident_id, control_id, 'Barrier: ' || coalesce(name, '') || '\nRole: ' || coalesce(barrier_role, '') || '\nLOD Basis: N/A' AS barrier_role_match_text, 'other_' || barrier_type AS barrier_family, barrier_type, side, line_of_defense,
      coalesce(barrier_status, 'unknown') AS barrier_status, barrier_failed, barrier_failed_human, coalesce(human_contribution_value, '') AS human_contribution_value, {", ".join(f"coalesce({p}, false) AS {p}" for p in PIFS)},
      CASE WHEN supporting_text_count = 0 THEN '[]' ELSE '["quote ' || supporting_text_count || '"]' END AS supporting_text, confidence, coalesce(summary, '') AS incident_summary
    FROM controls c LEFT JOIN described d ON c.incident_id = d.incident_id""",
    CONTROLS,
    INCIDENTS,
    _VALUED,
    _DESCRIBED,
)
def barrier_documents(spark, sf):
    n = F.col("supporting_text_count")
    flat = controls(spark, sf).withColumn("supporting_text", F.when(n > 0, F.array(F.concat(F.lit("quote "), n.cast("string")))))
    return context.barrier_documents(flat, _described(spark, sf), F.concat(F.lit("other_"), "barrier_type"))


@query("side_map", "SELECT incident_id, control_id, side AS mapped FROM controls", CONTROLS)
def side_map(spark, sf):
    drifted = F.when(F.col("side") == "prevention", "left").otherwise("right")
    return controls(spark, sf, named=False).select("incident_id", "control_id", taxonomy.side_of(drifted).alias("mapped"))


_PREDICTED = """predicted AS (SELECT incident_id, control_id_target AS control_id, (pathway_sequence_target * 13 + lod_numeric_cond * 7) % 100 / 100.0::DOUBLE AS p FROM features WHERE control_id_cond = 'C-001')"""


def _asked(spark, sf):
    named = threats(spark, sf).withColumn("threat_name", F.when(F.col("threat_id") == "T-001", "Pump leak").when(F.col("threat_id") == "T-002", "Operator error").otherwise("Loss of power"))
    score = lambda rows: rows.withColumn("p", (F.col("pathway_sequence_target") * 13 + F.col("lod_numeric_cond") * 7) % 100 / F.lit(100.0))
    return controls(spark, sf, named=False), named, "C-001", score


@query("ranked_targets", "SELECT incident_id, control_id, p, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY p DESC, control_id) AS INTEGER) AS place, CAST(rank() OVER (PARTITION BY incident_id ORDER BY p DESC) AS INTEGER) AS rank FROM predicted", CONTROLS, INCIDENTS, THREATS, _STATS, _NAMED, _SCENARIO, _PREDICTED)
def ranked_targets(spark, sf):
    return api.rank_targets(*_asked(spark, sf))


@query("predict_cascading", f"SELECT incident_id, control_id, p, CASE WHEN p >= {cascade.P80} THEN 'HIGH' WHEN p >= {cascade.P60} THEN 'MEDIUM' ELSE 'LOW' END AS band FROM predicted", CONTROLS, INCIDENTS, THREATS, _STATS, _NAMED, _SCENARIO, _PREDICTED)
def predict_cascading(spark, sf):
    """What the first barrier's failure means for every other barrier of its incident."""
    factors = incidents(spark, sf).select("incident_id", "pif_procedures", "pif_tools_equipment")
    return api.predict_cascading(*_asked(spark, sf), factors)

"""Queries over incident JSON, run reports, classifier metrics and models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import boosting, coercion, metrics, ml, validation
from ..session import work_folder
from ..sources import sinks
from .adapters import CONTROLS, controls
from .registry import query, table

_STATUS_DRIFT = {"active": "in place", "failed": "Broken", "not_installed": "missing", "degraded": "partial"}


def _quoted(c):
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


def _payloads(spark, sf):
    """One JSON document an incident, with values that drifted in every way that coercion knows; every seventh one is cut off."""
    k, lod = F.col("control_seq"), F.col("lod_numeric")
    side = F.when(k % 7 == 0, "x").when(k % 3 == 0, F.when(F.col("side") == "prevention", "left").otherwise("Recovery")).otherwise(F.col("side"))
    drifted = F.lit(None).cast("string")
    for name, other in _STATUS_DRIFT.items():
        drifted = F.when(F.col("barrier_status") == name, other).otherwise(drifted)
    status = F.when(k % 2 == 0, F.coalesce(drifted, "barrier_status")).otherwise(F.col("barrier_status"))
    line = F.when(lod == 99, _quoted(F.lit("Other"))).when(k % 2 == 0, lod.cast("string")).when(k % 5 == 0, _quoted(lod.cast("string"))).otherwise(_quoted(F.col("line_of_defense")))
    human = F.when(k % 4 == 0, F.lit('["a","b"]')).when(k % 4 == 2, "5").otherwise(_quoted(F.col("human_contribution_value")))
    performance = F.when(k % 6 == 5, "").otherwise(F.concat(F.lit(',"performance":{"barrier_status":'), _quoted(status), F.lit("}")))
    control = F.concat(
        F.lit('{"control_id":'), _quoted(F.col("control_id")), F.lit(',"side":'), _quoted(side), F.lit(',"line_of_defense":'), line, performance, F.lit(',"human":{"human_contribution_value":'), human, F.lit("}}")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("control_seq", control.alias("j")))), lambda x: x["j"]), ",")
    docs = controls(spark, sf, named=False).groupBy("incident_id").agg(joined.alias("c"))
    key = F.col("incident_id")
    kind = F.when(key % 3 == 0, F.lit('["fire","spill"]')).when(key % 3 == 1, F.lit('""')).otherwise(F.lit("7"))
    summary = F.when(key % 4 != 0, F.lit(',"summary":"s"')).otherwise("")
    threats = F.when(key % 5 == 0, F.lit('"threats":[{"id":"T1","name":"n"}],')).otherwise("")
    factors = F.when(key % 2 == 0, F.lit(',"pifs":{"people":{"competence_mentioned":true}}')).otherwise("")
    body = F.concat(F.lit('{"incident_id":"'), key.cast("string"), F.lit('","event":{"incident_type":'), kind, summary, F.lit('},"bowtie":{'), threats, F.lit('"controls":['), F.col("c"), F.lit("]}"), factors)
    return coercion.parse(docs.select("incident_id", F.when(key % 7 == 0, body).otherwise(F.concat(body, F.lit("}"))).alias("payload")))


_DRIFTED = ", ".join(f"'{s}'" for s in _STATUS_DRIFT)
_COERCED = f"""coerced AS (SELECT incident_id, control_seq AS k, control_seq - 1 AS pos, control_id, CASE WHEN control_seq % 7 = 0 THEN 'prevention' ELSE side END AS side, CASE WHEN lod_numeric = 99 THEN 'unknown' ELSE line_of_defense END AS line_of_defense,
  CASE WHEN control_seq % 6 = 5 THEN 'unknown' ELSE coalesce(barrier_status, 'unknown') END AS barrier_status, CASE control_seq % 4 WHEN 0 THEN 'a; b' WHEN 2 THEN '5' ELSE coalesce(human_contribution_value, 'unknown') END AS human_contribution_value,
  lod_numeric AS lod, barrier_status AS was, human_contribution_value AS told FROM controls WHERE incident_id % 7 <> 0),
 docs AS (SELECT DISTINCT incident_id FROM controls), good AS (SELECT incident_id FROM docs WHERE incident_id % 7 <> 0)"""


@query("coerced_controls", "SELECT incident_id, pos, control_id, side, line_of_defense, barrier_status, human_contribution_value FROM coerced", CONTROLS, _COERCED)
def coerced_controls(spark, sf):
    return coercion.coerced_controls(_payloads(spark, sf))


_RULES = {
    "side_mapped": "k % 7 <> 0 AND k % 3 = 0", "side_default_prevention": "k % 7 = 0", "lod_unknown": "lod = 99", "lod_int_to_enum": "lod <> 99 AND k % 2 = 0", "lod_strnum_to_enum": "lod <> 99 AND k % 2 <> 0 AND k % 5 = 0",
    "performance_created": "k % 6 = 5", "barrier_status_missing": "k % 6 = 5 OR was IS NULL", "barrier_status_mapped": f"k % 6 <> 5 AND k % 2 = 0 AND was IN ({_DRIFTED})",
    "human_value_list_to_str": "k % 4 = 0", "human_value_to_str": "k % 4 = 2", "human_value_none_to_unknown": "k % 4 IN (1, 3) AND told IS NULL",
}
_DOC_RULES = {"incident_type_list_to_str": "incident_id % 3 = 0", "incident_type_empty_to_unknown": "incident_id % 3 = 1", "incident_type_to_str": "incident_id % 3 = 2", "threat_id_remapped": "incident_id % 5 = 0"}


@query(
    "coercion_counts",
    "SELECT * FROM (" + " UNION ALL ".join([*(f"SELECT '{n}' AS coercion, count(*) AS n FROM coerced WHERE {r}" for n, r in _RULES.items()), *(f"SELECT '{n}', count(*) FROM good WHERE {r}" for n, r in _DOC_RULES.items())]) + ") WHERE n > 0",
    CONTROLS,
    _COERCED,
)
def coercion_counts(spark, sf):
    return coercion.coercion_counts(_payloads(spark, sf))


@query("incident_types", "SELECT incident_id, CASE incident_id % 3 WHEN 0 THEN 'fire; spill' WHEN 1 THEN 'unknown' ELSE '7' END AS incident_type FROM good", CONTROLS, _COERCED)
def incident_types(spark, sf):
    return _payloads(spark, sf).where("v is not null").select("incident_id", coercion.incident_type(F.col("v")).alias("incident_type"))


_BROKEN = f"""broken AS (SELECT incident_id, 'document: not JSON' AS error FROM docs WHERE incident_id % 7 = 0
  UNION ALL SELECT incident_id, 'event -> incident_type: Input should be a valid string' FROM good WHERE incident_id % 3 <> 1
  UNION ALL SELECT incident_id, 'bowtie -> threats -> 0 -> threat_id: Field required' FROM good WHERE incident_id % 5 = 0
  UNION ALL SELECT incident_id, 'bowtie -> controls -> ' || pos || $$ -> side: Input should be 'prevention' or 'mitigation'$$ FROM coerced WHERE k % 7 = 0 OR k % 3 = 0
  UNION ALL SELECT incident_id, 'bowtie -> controls -> ' || pos || $$ -> line_of_defense: Input should be '1st', '2nd', '3rd', 'recovery' or 'unknown'$$ FROM coerced WHERE lod = 99 OR k % 2 = 0 OR k % 5 = 0
  UNION ALL SELECT incident_id, 'bowtie -> controls -> ' || pos || $$ -> performance -> barrier_status: Input should be 'active', 'degraded', 'failed', 'bypassed', 'not_installed' or 'unknown'$$ FROM coerced
    WHERE k % 6 <> 5 AND (was IS NULL OR (k % 2 = 0 AND was IN ({_DRIFTED})))
  UNION ALL SELECT incident_id, 'bowtie -> controls -> ' || pos || ' -> human -> human_contribution_value: Input should be a valid string' FROM coerced WHERE k % 2 = 0)"""


@query("validation_errors", "SELECT * FROM broken", CONTROLS, _COERCED, _BROKEN)
def validation_errors(spark, sf):
    return validation.validation_errors(_payloads(spark, sf))


@query("validity", "SELECT incident_id, incident_id NOT IN (SELECT incident_id FROM broken) AS valid FROM docs", CONTROLS, _COERCED, _BROKEN)
def validity(spark, sf):
    return validation.validity(_payloads(spark, sf)).select("incident_id", "valid")


_FACTS = """facts AS (SELECT incident_id, CASE WHEN incident_id % 7 <> 0 THEN n END AS n_controls, incident_id % 7 <> 0 AS has_controls, incident_id % 7 <> 0 AND incident_id % 4 <> 0 AS has_summary, incident_id % 7 <> 0 AND incident_id % 2 = 0 AS has_pifs,
  false AS has_hazards, incident_id % 7 <> 0 AND incident_id % 5 = 0 AS has_threats, false AS has_consequences FROM (SELECT incident_id, count(*) AS n FROM controls GROUP BY 1))"""


@query(
    "quality_gate",
    "SELECT count(*) AS documents, "
    + ", ".join(f"count(*) FILTER (has_{p}) AS has_{p}, round(count(*) FILTER (has_{p}) * 100.0::DOUBLE / count(*), 1) AS has_{p}_pct" for p in coercion.GATE_PARTS)
    + ", min(n_controls) AS least, round(quantile_cont(n_controls, 0.5), 1) AS p50, round(quantile_cont(n_controls, 0.9), 1) AS p90, max(n_controls) AS most FROM facts",
    CONTROLS,
    _FACTS,
)
def quality_gate(spark, sf):
    return coercion.quality_gate(coercion.gate_facts(_payloads(spark, sf)).drop("incident_id"))


def _shapes(spark, sf):
    """Documents whose fields come in every shape that the schema takes, under their own and drifted names."""
    key = F.col("o_orderkey")
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (key % n + 1).cast("int"))
    body = F.concat(
        F.lit('{"incident_id":"i","context":{'), pick(5, '"operating_phase":" Drilling "', '"operating_phase":["A","b"]', '"operating_phase":7', '"operating_phase":null', '"region":"r"'),
        pick(6, "", ',"materials":"oil"', ',"materials":["a",1]', ',"materials":{"t":"crude","u":null}', ',"materials":null', ',"materials":7'),
        F.lit('},"event":{'), pick(4, '"top_event":"t"', '"type":["x","y"]', '"top_event":null', '"top_event":3'), pick(3, ',"category":"c"', ',"incident_type":"i","category":"c"', ""),
        pick(2, ',"description":"d"', ',"summary":"s","description":"d"'), pick(4, ',"costs":{}', ',"costs":5', ',"costs":"9"', ""), F.lit("}"),
        pick(3, ',"controls":[{"control_id":"a"},{"control_id":"b"}]', ',"controls":[1],"bowtie":{"controls":[{"control_id":"a"}]}', ',"controls":[{"control_id":"a"}],"bowtie":{"controls":[]}'), F.lit("}"),
    )
    return coercion.parse(table(spark, sf, "orders").select(key.alias("incident_id"), body.alias("payload")))


@query(
    "schema_fields",
    """SELECT o_orderkey AS incident_id, ['drilling', 'a; b', '7', 'unknown', 'unknown'][o_orderkey % 5 + 1] AS operating_phase, ['', 'oil', 'a|1', 'crude', '', '7'][o_orderkey % 6 + 1] AS materials, ['t', 'x; y', 'unknown', '3'][o_orderkey % 4 + 1] AS top_event,
    ['c', 'i', 'unknown'][o_orderkey % 3 + 1] AS incident_type, ['d', 's'][o_orderkey % 2 + 1] AS summary, [NULL, '5', '9', NULL][o_orderkey % 4 + 1] AS costs, CAST([2, 1, 1][o_orderkey % 3 + 1] AS BIGINT) AS n_controls FROM orders""",
)
def schema_fields(spark, sf):
    fields = coercion.schema_fields(F.col("v"))
    return _shapes(spark, sf).select("incident_id", *[(F.array_join(c, "|") if n == "materials" else c).alias(n) for n, c in fields.items()])


def _runs(spark, sf):
    k = F.col("event_id")
    errors = F.when(F.col("event_type") != "error", "").otherwise(F.concat(F.lit("loc"), (k % 17).cast("string"), F.lit(" -> field: required; value: "), F.repeat(F.lit("x"), 70), (k % 3).cast("string")))
    return table(spark, sf, "events").select(errors.alias("errors"))


@query("run_report", "SELECT count(*) AS processed, count(*) FILTER (event_type <> 'error') AS valid, round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 3) AS valid_rate FROM events")
def run_report(spark, sf):
    return coercion.run_report(_runs(spark, sf))


@query(
    "top_errors",
    """SELECT error, count(*) AS n FROM (SELECT 'loc' || (event_id % 17) || ' -> field: required' AS error FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'value: ' || repeat('x', 53) FROM events WHERE event_type = 'error') GROUP BY 1 ORDER BY n DESC, error LIMIT 10""",
)
def top_errors(spark, sf):
    return coercion.top_errors(_runs(spark, sf))


_SCORED = "scored AS (SELECT doc_id, 'inc-' || doc_id % 50 AS grp, quality AS y, (n_chars * 7 % 101) / 101.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") * 7 % 101) / F.lit(101.0)
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", F.concat(F.lit("inc-"), (F.col("doc_id") % 50).cast("string")).alias("grp"), F.col("quality").alias("y"), score.alias("score"))


_COUNTS = "count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y <> 1) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y <> 1) AS tn"
_METRICS = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS f1,
  CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))::DOUBLE) ELSE 0.0::DOUBLE END AS mcc"""
#: The largest groups first, those of one size at once: the loads that the folds would have before each next group, in order.
_FOLDS = """RECURSIVE grps AS (SELECT grp, count(*) AS n FROM scored GROUP BY grp), hist AS (SELECT n, count(*) AS c, row_number() OVER (ORDER BY n DESC) AS k FROM grps GROUP BY n),
 filled AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS quota UNION ALL
   SELECT k, n, list_transform(range(1, 6), lambda f: loads[f] + n * quota[f])::BIGINT[], quota FROM (
   SELECT k, n, loads, list_transform(range(0, 5), lambda f: len(list_filter(turns, lambda t: t % 8 = f)))::BIGINT[] AS quota FROM (
   SELECT h.k, h.n, loads, list_sort(flatten(list_transform(range(0, 5), lambda f: list_transform(range(0, h.c), lambda j: (loads[f + 1] + j * h.n) * 8 + f))))[1:h.c] AS turns FROM filled JOIN hist h ON h.k = filled.k + 1))),
 folds AS (SELECT grp, n, len(list_filter(range(1, 5), lambda f: list_sum(quota[1:f]) <= place))::INTEGER AS fold FROM (SELECT grp, n, row_number() OVER (PARTITION BY n ORDER BY grp) - 1 AS place FROM grps) JOIN (SELECT n, quota FROM filled WHERE k > 0) USING (n))"""
_AUC = """ranked AS (SELECT fold, y, (rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0::DOUBLE) AS r FROM scored JOIN folds USING (grp)),
 aucs AS (SELECT fold, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1))::DOUBLE, 9) AS auc FROM ranked GROUP BY 1)"""


@query("binary_metrics", f"SELECT *, {_METRICS} FROM (SELECT {_COUNTS} FROM scored)", _SCORED)
def binary_metrics(spark, sf):
    return metrics.binary_metrics(_scored(spark, sf))


@query(
    "roc_auc",
    """SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1))::DOUBLE, 9) AS auc
    FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)""",
    _SCORED,
)
def roc_auc(spark, sf):
    return metrics.roc_auc(_scored(spark, sf))


def _dealt(spark, sf):
    rows = _scored(spark, sf)
    return rows.join(metrics.fold_assignment(rows, "grp").select("grp", "fold"), "grp")


@query("fold_assignment", "SELECT grp, n, fold FROM folds", _SCORED, _FOLDS)
def fold_assignment(spark, sf):
    return metrics.fold_assignment(_scored(spark, sf), "grp")


@query("fold_metrics", f"SELECT *, {_METRICS} FROM (SELECT fold, {_COUNTS} FROM scored JOIN folds USING (grp) GROUP BY 1)", _SCORED, _FOLDS)
def fold_metrics(spark, sf):
    return metrics.binary_metrics(_dealt(spark, sf), ["fold"])


@query("fold_auc", "SELECT fold, auc FROM aucs", _SCORED, _FOLDS, _AUC)
def fold_auc(spark, sf):
    return metrics.roc_auc(_dealt(spark, sf), ["fold"])


@query("auc_gate", "SELECT round(avg(auc), 6) AS mean_auc, min(auc) AS least_auc, avg(auc) >= 0.70 AND min(auc) >= 0.60 AS passed FROM aucs", _SCORED, _FOLDS, _AUC)
def auc_gate(spark, sf):
    return metrics.auc_gate(metrics.roc_auc(_dealt(spark, sf), ["fold"]))


@query("risk_thresholds", "SELECT round(quantile_cont(score, 0.6), 9) AS p60, round(quantile_cont(score, 0.8), 9) AS p80 FROM scored", _SCORED)
def risk_thresholds(spark, sf):
    return metrics.thresholds(_scored(spark, sf))


def _matrix(spark, sf):
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.split(text, " "))
    marks = F.length(F.regexp_replace(text, r"[^#$%&*|]", ""))
    docs = table(spark, sf, "documents").select("doc_id", F.log1p(F.length(text)).alias("size"), (F.length(text) / words).alias("word_length"), (marks / F.greatest(F.length(text), F.lit(1))).alias("marks"))
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_COLUMNS = ["size", "word_length", "marks"]


@query("logreg_predictions")
def logreg_predictions(spark, sf):
    rows = ml.weighted(_matrix(spark, sf), "y")
    return ml.predictions(ml.logistic(_COLUMNS, "y").fit(rows), rows, "doc_id", "y")


@query("gbt_predictions")
def gbt_predictions(spark, sf):
    rows = ml.weighted(_matrix(spark, sf), "y")
    return ml.predictions(ml.boosted(_COLUMNS, "y").fit(rows), rows, "doc_id", "y")


_TREES = 12


def _file_model(spark, start: int = 0) -> boosting.BoostedTrees:
    """Twelve trees of two levels by a rule, as a file of the exchanged layout, read back."""
    trees = []
    for k in range(start, start + _TREES):
        at = lambda f, k=k: (6 + k % 4 * 0.5, 4 + k % 5 * 0.5, k % 3 / 64)[f % 3]
        trees.append(
            {
                "left_children": [1, 3, 5, -1, -1, -1, -1], "right_children": [2, 4, 6, -1, -1, -1, -1], "split_indices": [k % 3, (k + 1) % 3, (k + 2) % 3, 0, 0, 0, 0],
                "split_conditions": [at(k), at(k + 1), at(k + 2), *(((k * 7 + node * 3) % 11 - 5) / 16 for node in range(3, 7))], "default_left": [(k + node) % 2 for node in range(7)],
                "sum_hessian": [1.0] * 7, "split_type": [0] * 7,
            }
        )
    param = {"base_score": "3E-1", "num_feature": "3", "num_class": "0"}
    learner = {"feature_names": _COLUMNS, "gradient_booster": {"model": {"trees": trees}}, "learner_model_param": param, "objective": {"name": "binary:logistic"}}
    path = work_folder(spark, "model")
    sinks.write_text(spark, path, json.dumps({"learner": learner}))
    return boosting.read_boosted(spark, path)


def _walk(prefix: str, start: int = 0) -> str:
    return f"""{prefix}nodes AS (SELECT k, node, CASE WHEN node < 3 THEN (k + node) % 3 ELSE -1 END AS f, [6 + k % 4 * 0.5, 4 + k % 5 * 0.5, (k % 3) / 64.0]::FLOAT[] AS cut, (k + node) % 2 = 1 AS lost_left, ((k * 7 + node * 3) % 11 - 5) / 16.0::DOUBLE AS value
   FROM range({start}, {start + _TREES}) a(k), range(7) b(node)),
 {prefix}walk AS (SELECT doc_id, v, k, 0::BIGINT AS node FROM x, range({start}, {start + _TREES}) a(k) UNION ALL
   SELECT doc_id, v, k, 2 * node + CASE WHEN coalesce(v[f + 1]::FLOAT < cut[f + 1], lost_left) THEN 1 ELSE 2 END FROM {prefix}walk JOIN {prefix}nodes USING (k, node) WHERE f >= 0),
 {prefix}scores AS (SELECT doc_id, 1 / (1 + exp(-(ln(0.3::DOUBLE / 0.7::DOUBLE) + sum(value)))) AS score FROM {prefix}walk JOIN {prefix}nodes USING (k, node) WHERE f < 0 GROUP BY doc_id)"""


_X = """RECURSIVE x AS (SELECT doc_id, [ln(length(t) + 1), length(t) / len(string_split(t, ' '))::DOUBLE, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE length(regexp_replace(t, '[^#$%&*|]', '', 'g')) / greatest(length(t), 1)::DOUBLE END] AS v
   FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) JOIN labels USING (doc_id))"""
_WALK = f"{_X}, {_walk('file_')}"


def _candidates(spark, sf):
    return _matrix(spark, sf).withColumn("marks", F.when(F.col("doc_id") % 7 != 0, F.col("marks")))


def _file_scores(spark, sf):
    return _file_model(spark).scored(_candidates(spark, sf), "doc_id")


@query("file_model_scores", "SELECT doc_id, round(score, 9) AS score FROM file_scores", _WALK)
def file_model_scores(spark, sf):
    return _file_scores(spark, sf).withColumn("score", F.round("score", 9))


@query("file_model_thresholds", "SELECT round(quantile_cont(score, 0.6), 9) AS p60, round(quantile_cont(score, 0.8), 9) AS p80 FROM file_scores", _WALK)
def file_model_thresholds(spark, sf):
    """The tiers of risk from the scores of a model that a file holds."""
    return metrics.thresholds(_file_scores(spark, sf))


_BOTH = """both_models AS (SELECT doc_id, doc_id % 50 AS grp, round(a.score, 9) AS probability_y_fail, round(b.score, 9) AS probability_y_hf_fail FROM file_scores a JOIN other_scores b USING (doc_id))"""
_TIER = "CASE WHEN probability_{0} >= 0.66 THEN 'HIGH' WHEN probability_{0} >= 0.33 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier_{0}, CAST(rank() OVER (PARTITION BY grp ORDER BY probability_{0} DESC) AS INTEGER) AS risk_rank_{0}"


@query("ranked_by_two_models", f"SELECT doc_id, probability_y_fail, probability_y_hf_fail, {_TIER.format('y_fail')}, {_TIER.format('y_hf_fail')} FROM both_models", _WALK, _walk("other_", 100), _BOTH)
def ranked_by_two_models(spark, sf):
    """Candidates of fifty questions, scored and ranked by two models at once."""
    rows = _candidates(spark, sf).withColumn("grp", F.col("doc_id") % 50)
    found = ml.score_targets(rows, {"y_fail": _file_model(spark), "y_hf_fail": _file_model(spark, 100)}, ["grp"])
    return found.drop("grp", "y", *_COLUMNS)


@query("linear_contributions", "SELECT incident_id, control_id, 'quantity' AS feature, round(0.5::DOUBLE * (quantity - (SELECT avg(quantity) FROM controls)), 6) AS value FROM controls", CONTROLS)
def linear_contributions(spark, sf):
    found = ml.linear_contributions(controls(spark, sf, named=False), ["quantity"], {"quantity": 0.5}, ["incident_id", "control_id"])
    return found.withColumn("value", F.round("value", 6))

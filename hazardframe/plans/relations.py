"""Queries over controls and incidents: coverage, baselines, mining, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import DID_NOT_PERFORM, MODEL_PIFS, STATUSES
from ..operators import baseline, coverage, mining, profiling, taxonomy
from .adapters import CONTROLS, INCIDENTS, controls, incidents
from .registry import query, table

#: A small taxonomy whose keywords occur in the test parts' names; real ones are loaded from a file.
TAXONOMY = taxonomy.Taxonomy(
    {
        ("prevention", "administrative"): {"training": ["small", "old"], "procedures": ["red"], "planning": ["ring", "new b"]},
        ("prevention", "engineering"): {"mechanical_integrity": ["bolt", "large"], "detection": ["blue", "hot"]},
        ("mitigation", "administrative"): {"drills": ["cold", "standard"], "medical": ["gear"]},
        ("mitigation", "engineering"): {"alarms": ["widget", "promo"], "relief": ["new"]},
    }
)


def _family_sql(name: str = "name", role: str = "barrier_role") -> str:
    text = f"trim(regexp_replace(regexp_replace(lower(coalesce({name}, '') || ' ' || coalesce({role}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    cases = []
    for (side, kind), families in TAXONOMY.quadrants.items():
        inner = " ".join(f"WHEN {' OR '.join(f'contains({text}, $${w}$$)' for w in words)} THEN '{f}'" for f, words in families.items())
        other = "other_admin" if kind == "administrative" else f"other_{kind}"
        cases.append(f"WHEN side = '{side}' AND barrier_type = '{kind}' THEN CASE {inner} ELSE '{other}' END")
    return f"CASE {' '.join(cases)} ELSE 'other_' || barrier_type END"


def with_family(spark, sf):
    return controls(spark, sf).withColumn("family", TAXONOMY.family(F.col("name"), F.col("barrier_role"), F.col("side"), F.col("barrier_type")))


FAMILIES = f"families AS (SELECT *, {_family_sql()} AS family FROM controls)"
FAILED = ", ".join(f"'{s}'" for s in DID_NOT_PERFORM)
ITEMS = f"items AS (SELECT DISTINCT incident_id, family AS item FROM families WHERE barrier_status IN ({FAILED}))"
PAIRS = "pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y USING (incident_id) WHERE x.item < y.item GROUP BY 1, 2)"
_NORM = "lower(trim(coalesce(barrier_status, '')))"


@query("flat_incidents", "SELECT * FROM incidents", INCIDENTS)
def flat_incidents(spark, sf):
    return incidents(spark, sf)


@query("flat_controls", "SELECT * EXCLUDE (linked_threat_ids), array_to_string(linked_threat_ids, ',') AS linked_threat_ids FROM controls", CONTROLS)
def flat_controls(spark, sf):
    return controls(spark, sf).withColumn("linked_threat_ids", F.array_join("linked_threat_ids", ","))


@query(
    "source_agency",
    """SELECT incident_id, CASE WHEN agency <> '' THEN agency WHEN lower(doc_type) LIKE '%bsee%' THEN 'BSEE' WHEN lower(doc_type) LIKE '%accident investigation%' THEN 'BSEE'
    WHEN lower(doc_type) LIKE '%csb%' THEN 'CSB' WHEN lower(doc_type) LIKE '%recommendation status change%' THEN 'CSB' WHEN url LIKE '%tsb.gc.ca%' THEN 'TSB'
    WHEN json_path LIKE 'data/PHMSA/%' THEN 'PHMSA' ELSE 'UNKNOWN' END AS source_agency FROM incidents""",
    INCIDENTS,
)
def source_agency(spark, sf):
    return incidents(spark, sf).select("incident_id", taxonomy.source_agency(F.col("agency"), F.col("doc_type"), F.col("url"), F.col("json_path")).alias("source_agency"))


_COVERAGE = f"""SELECT o_orderkey AS incident_id, count(control_id) AS controls_total,
  {", ".join(f"count(CASE WHEN {_NORM} = '{s}' THEN control_id END) AS status_{s}" for s in STATUSES)},
  count(CASE WHEN {_NORM} = '' THEN control_id END) AS status_blank,
  count(CASE WHEN supporting_text_count > 0 THEN 1 END) AS with_text, count(CASE WHEN confidence = 'high' THEN 1 END) AS high_confidence
  FROM orders LEFT JOIN controls ON incident_id = o_orderkey GROUP BY o_orderkey"""


@query(
    "control_coverage",
    f"SELECT *, CASE WHEN controls_total > 0 THEN (status_active + 0.5::DOUBLE * status_degraded) / controls_total ELSE 0.0::DOUBLE END AS coverage_score FROM ({_COVERAGE})",
    CONTROLS,
)
def control_coverage(spark, sf):
    universe = table(spark, sf, "orders").select(F.col("o_orderkey").alias("incident_id"))
    return coverage.coverage(controls(spark, sf, named=False), universe)


_GAPS = f"""gaps AS (SELECT incident_id, control_id, name, side, barrier_role, barrier_type, line_of_defense, barrier_status, supporting_text_count, confidence FROM controls
  WHERE {_NORM} IN ('failed', 'bypassed', 'not_installed', 'unknown', '') OR supporting_text_count <= 0)"""


@query("control_gaps", "SELECT * FROM gaps", CONTROLS, _GAPS)
def control_gaps(spark, sf):
    return coverage.gaps(controls(spark, sf))


@query(
    "gap_rollups",
    " UNION ALL ".join(f"SELECT '{coverage.ROLLUP_NAMES.get(d, 'by_' + d)}' AS rollup, '{d}' AS dimension, {d} AS value, count(*) AS gap_count FROM gaps WHERE {d} IS NOT NULL GROUP BY {d}" for d in coverage.ROLLUPS),
    CONTROLS,
    _GAPS,
)
def gap_rollups(spark, sf):
    return coverage.gap_rollups(coverage.gaps(controls(spark, sf)))


@query("status_distribution", "SELECT barrier_status, count(*) AS n, round(count(*) / (SELECT count(*) FROM controls)::DOUBLE, 4) AS share FROM controls WHERE barrier_status IS NOT NULL GROUP BY 1", CONTROLS)
def status_distribution(spark, sf):
    return baseline.status_distribution(controls(spark, sf, named=False))


def _rates(name: str, dimension: str):
    sql = f"SELECT {dimension} AS value, count(*) FILTER (barrier_failed) AS failed, count(*) AS total, round(count(*) FILTER (barrier_failed) / count(*)::DOUBLE, 4) AS rate FROM controls WHERE {dimension} IS NOT NULL GROUP BY 1"
    query(name, sql, CONTROLS)(lambda spark, sf: baseline.failure_rates(controls(spark, sf, named=False), dimension))


for _name, _dimension in (("failure_rate_by_type", "barrier_type"), ("failure_rate_by_side", "side"), ("failure_rate_by_lod", "line_of_defense")):
    _rates(_name, _dimension)


@query(
    "cofailure_pairs",
    """SELECT x.name AS a, y.name AS b, count(*) AS pairs FROM controls x JOIN controls y USING (incident_id)
    WHERE x.barrier_failed AND y.barrier_failed AND x.name < y.name GROUP BY 1, 2""",
    CONTROLS,
)
def cofailure_pairs(spark, sf):
    return baseline.cofailures(controls(spark, sf))


@query(
    "human_contribution",
    """SELECT count(*) AS controls, count(*) FILTER (human_contribution_value <> '') AS mentioned, round(count(*) FILTER (human_contribution_value <> '') / count(*)::DOUBLE, 4) AS mentioned_share,
    count(*) FILTER (barrier_failed_human) AS failed_human, round(count(*) FILTER (barrier_failed_human) / count(*)::DOUBLE, 4) AS failed_human_share,
    count(*) FILTER (barrier_failed AND barrier_failed_human) AS failed_and_human, count(DISTINCT incident_id) AS incidents FROM controls""",
    CONTROLS,
)
def human_contribution(spark, sf):
    return baseline.human_contribution(controls(spark, sf, named=False))


def _bowtie(spark, sf):
    """What incidents had (names may repeat), the reference barriers, and all incidents."""
    rows = controls(spark, sf)
    present = rows.where("not barrier_failed").select("incident_id", "side", F.substring("name", 1, 8).alias("name"))
    reference = rows.where("lod_numeric = 1 and quantity >= 49").select("side", F.upper(F.substring("name", 1, 8)).alias("name")).distinct()
    return present, reference, table(spark, sf, "orders").select(F.col("o_orderkey").alias("incident_id"))


def _fleet(spark, sf):
    return baseline.fleet_coverage(*_bowtie(spark, sf))


_FLEET = """wanted AS (SELECT DISTINCT side, upper(substr(name, 1, 8)) AS name FROM controls WHERE lod_numeric = 1 AND quantity >= 49),
 present AS (SELECT incident_id, side, lower(substr(name, 1, 8)) AS key FROM controls WHERE NOT barrier_failed),
 shares AS (SELECT o_orderkey AS incident_id,
   coalesce(least(1.0, count(*) FILTER (p.side = 'prevention' AND key IN (SELECT lower(name) FROM wanted WHERE side = 'prevention')) / (SELECT count(*) FROM wanted WHERE side = 'prevention')::DOUBLE), 0) AS prevention,
   coalesce(least(1.0, count(*) FILTER (p.side = 'mitigation' AND key IN (SELECT lower(name) FROM wanted WHERE side = 'mitigation')) / (SELECT count(*) FROM wanted WHERE side = 'mitigation')::DOUBLE), 0) AS mitigation,
   coalesce(least(1.0, count(*) FILTER (key IN (SELECT lower(name) FROM wanted)) / (SELECT count(*) FROM wanted)::DOUBLE), 0) AS overall
   FROM orders LEFT JOIN present p ON incident_id = o_orderkey GROUP BY 1)"""


@query("fleet_coverage", "SELECT * FROM shares", CONTROLS, _FLEET)
def fleet_coverage(spark, sf):
    return _fleet(spark, sf)


@query("fleet_means", "SELECT count(*) AS incidents, round(avg(prevention), 6) AS prevention, round(avg(mitigation), 6) AS mitigation, round(avg(overall), 6) AS overall FROM shares", CONTROLS, _FLEET)
def fleet_means(spark, sf):
    means = baseline.fleet_means(_fleet(spark, sf))
    return means.select("incidents", *[F.round(c, 6).alias(c) for c in means.columns[1:]])


@query(
    "fleet_gaps",
    """SELECT o_orderkey AS incident_id, (SELECT count(*) FROM wanted) - coalesce(n, 0) AS gaps, (SELECT count(*) FROM wanted WHERE side = 'prevention') - coalesce(p, 0) AS prevention_gaps FROM orders
    LEFT JOIN (SELECT incident_id, count(*) AS n, count(*) FILTER (side = 'prevention') AS p FROM (SELECT DISTINCT incident_id, key FROM present) JOIN wanted ON key = lower(name) GROUP BY 1) ON incident_id = o_orderkey""",
    CONTROLS,
    _FLEET,
)
def fleet_gaps(spark, sf):
    found = baseline.fleet_gaps(*_bowtie(spark, sf))
    return found.groupBy("incident_id").agg(F.count("*").alias("gaps"), F.count_if(F.col("side") == "prevention").alias("prevention_gaps"))


_LABELLED = f"""labelled AS (SELECT *, CAST(coalesce(barrier_status IN ({FAILED}), false) AS INTEGER) AS label_barrier_failed,
  CAST(coalesce(barrier_status IN ({FAILED}), false) AND barrier_failed_human AS INTEGER) AS label_barrier_failed_human FROM controls WHERE barrier_status IS DISTINCT FROM 'unknown')"""


def labelled(spark, sf):
    return profiling.labels(profiling.known(controls(spark, sf)))


@query("labels_known", "SELECT incident_id, control_id, barrier_status, label_barrier_failed, label_barrier_failed_human FROM labelled", CONTROLS, _LABELLED)
def labels_known(spark, sf):
    return labelled(spark, sf).select("incident_id", "control_id", "barrier_status", "label_barrier_failed", "label_barrier_failed_human")


@query("barrier_family", "SELECT incident_id, control_id, family FROM families", CONTROLS, FAMILIES)
def barrier_family(spark, sf):
    return with_family(spark, sf).select("incident_id", "control_id", "family")


_ENCODED = ["side", "barrier_type", "line_of_defense", "family"]


@query(
    "feature_matrix",
    f"""SELECT incident_id, control_id, {", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in _ENCODED)}, supporting_text_count, control_seq - 1 AS pathway_sequence,
    label_barrier_failed, label_barrier_failed_human, {", ".join(f"CAST({p} AS INTEGER) AS {p}" for p in MODEL_PIFS)}
    FROM (SELECT *, {_family_sql()} AS family FROM labelled) JOIN incidents USING (incident_id)""",
    CONTROLS,
    INCIDENTS,
    _LABELLED,
)
def feature_matrix(spark, sf):
    rows = labelled(spark, sf).withColumn("family", TAXONOMY.family(F.col("name"), F.col("barrier_role"), F.col("side"), F.col("barrier_type")))
    wide = profiling.with_factors(rows, incidents(spark, sf).select("incident_id", *MODEL_PIFS))
    wide = profiling.encode_all(wide, _ENCODED, rows)
    return wide.select(
        "incident_id", "control_id", *[F.col(c).cast("long").alias(c) for c in _ENCODED], "supporting_text_count", (F.col("control_seq").cast("long") - 1).alias("pathway_sequence"), "label_barrier_failed", "label_barrier_failed_human", *MODEL_PIFS
    )


@query("ordinal_encoding", "SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(barrier_status, 'unknown') AS value FROM controls)", CONTROLS)
def ordinal_encoding(spark, sf):
    codes = profiling.ordinal_encoding(controls(spark, sf, named=False), "barrier_status")
    return codes.withColumn("code", F.col("code").cast("long"))


def _items(spark, sf):
    return mining.failed_items(with_family(spark, sf))


@query("transactions", "SELECT incident_id, string_agg(item, '|' ORDER BY item) AS items FROM items GROUP BY 1", CONTROLS, FAMILIES, ITEMS)
def transactions(spark, sf):
    return mining.transactions(_items(spark, sf)).withColumn("items", F.array_join("items", "|"))


@query("family_counts", "SELECT item, count(*) AS n FROM items GROUP BY 1", CONTROLS, FAMILIES, ITEMS)
def family_counts(spark, sf):
    return mining.item_counts(_items(spark, sf))


@query("pair_counts", "SELECT a, b, n FROM pairs", CONTROLS, FAMILIES, ITEMS, PAIRS)
def pair_counts(spark, sf):
    return mining.pair_counts(_items(spark, sf))


@query(
    "association_rules",
    """SELECT antecedent, consequent, n AS n_both, n / p::DOUBLE AS support, n / na::DOUBLE AS confidence, n * p / (na * nc)::DOUBLE AS lift FROM (
      SELECT a AS antecedent, b AS consequent, n FROM pairs UNION ALL SELECT b, a, n FROM pairs)
      JOIN (SELECT item AS antecedent, count(*) AS na FROM items GROUP BY 1) USING (antecedent) JOIN (SELECT item AS consequent, count(*) AS nc FROM items GROUP BY 1) USING (consequent),
      (SELECT count(DISTINCT incident_id) AS p FROM items) WHERE n / p::DOUBLE >= 0.005 AND n / na::DOUBLE >= 0.08 AND n * p / (na * nc)::DOUBLE > 1""",
    CONTROLS,
    FAMILIES,
    ITEMS,
    PAIRS,
)
def association_rules(spark, sf):
    return mining.association_rules(_items(spark, sf), 0.005, 0.08)


_PROFILED = ["barrier_status", "human_contribution_value", "line_of_defense", "name"]


@query("null_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values FROM controls" for c in _PROFILED), CONTROLS)
def null_profile(spark, sf):
    return profiling.null_profile(controls(spark, sf), _PROFILED)


@query("distinct_values", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM controls WHERE {c} IS NOT NULL" for c in _PROFILED), CONTROLS)
def distinct_values(spark, sf):
    return profiling.distinct_values(controls(spark, sf), _PROFILED)


def _two_sides(spark, sf):
    shifted = controls(spark, sf, named=False).select((F.col("incident_id") + F.when(F.col("incident_id") % 11 == 0, 10_000_000).otherwise(0)).alias("incident_id"))
    return shifted, table(spark, sf, "orders").select(F.col("o_orderkey").alias("incident_id"))


_SIDES = "l AS (SELECT DISTINCT CASE WHEN incident_id % 11 = 0 THEN incident_id + 10000000 ELSE incident_id END AS k FROM controls), r AS (SELECT DISTINCT o_orderkey AS k FROM orders)"


@query(
    "join_check",
    """SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys, (SELECT count(*) FROM l JOIN r USING (k)) AS matched,
    (SELECT count(*) FROM l ANTI JOIN r USING (k)) AS left_orphans, (SELECT count(*) FROM r ANTI JOIN l USING (k)) AS right_orphans""",
    CONTROLS,
    _SIDES,
)
def join_check(spark, sf):
    return profiling.join_check(*_two_sides(spark, sf), "incident_id")


@query("orphans", "SELECT k AS incident_id FROM l ANTI JOIN r USING (k)", CONTROLS, _SIDES)
def orphans(spark, sf):
    return profiling.orphans(*_two_sides(spark, sf), "incident_id")


@query(
    "label_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS label, count(*) AS n, CAST(sum({c}) AS BIGINT) AS positives, sum({c}) / count(*)::DOUBLE AS rate, CASE WHEN sum({c}) / count(*)::DOUBLE < 0.03 THEN 'low' WHEN sum({c}) / count(*)::DOUBLE > 0.25 THEN 'high' ELSE 'none' END AS warning FROM labelled"
        for c in ("label_barrier_failed", "label_barrier_failed_human")
    ),
    CONTROLS,
    _LABELLED,
)
def label_stats(spark, sf):
    return profiling.label_stats(labelled(spark, sf))


_FACTORED = f"factored AS (SELECT label_barrier_failed AS y, {', '.join(f'CAST({p} AS INTEGER) AS {p}' for p in MODEL_PIFS)} FROM labelled JOIN incidents USING (incident_id))"


@query("pif_sparsity", " UNION ALL ".join(f"SELECT '{p}' AS factor, sum({p}) / count(*)::DOUBLE AS share FROM factored" for p in MODEL_PIFS), CONTROLS, INCIDENTS, _LABELLED, _FACTORED)
def pif_sparsity(spark, sf):
    rows = profiling.with_factors(labelled(spark, sf), incidents(spark, sf).select("incident_id", *MODEL_PIFS))
    return profiling.factor_profile(rows, MODEL_PIFS, "label_barrier_failed").select("factor", "share")


#: p by Simpson's rule over the density of a correlation of independent columns, (1 - u^2)^((n - 4) / 2).
_P = """exp(lgamma(n / 2.0::DOUBLE - 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(n / 2.0::DOUBLE - 1)) * 2 * abs(r) / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp((n / 2.0::DOUBLE - 2) * ln(1 - (k / 2000.0::DOUBLE * r) * (k / 2000.0::DOUBLE * r)))))"""


@query("pif_correlation", f"SELECT factor, round(r, 6) AS r, round(1 - {_P}, 8) AS p FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS factor, coalesce(corr({p}, y), 0) AS r, count(*) AS n FROM factored" for p in MODEL_PIFS) + ")", CONTROLS, INCIDENTS, _LABELLED, _FACTORED)
def pif_correlation(spark, sf):
    rows = profiling.with_factors(labelled(spark, sf), incidents(spark, sf).select("incident_id", *MODEL_PIFS))
    return profiling.factor_profile(rows, MODEL_PIFS, "label_barrier_failed").select("factor", F.round("r", 6).alias("r"), F.round("p", 8).alias("p"))


def _cascade_rows(spark, sf):
    rows = controls(spark, sf, named=False).withColumn("lod_name", F.when(F.col("line_of_defense") == "recovery", "Other").otherwise(F.col("line_of_defense")))
    return rows.withColumn("lod_numeric", F.when(F.col("quantity") == 50, 99).otherwise(F.col("lod_numeric")))


_CASCADE = """cascade_rows AS (SELECT * EXCLUDE (lod_numeric), CASE WHEN line_of_defense = 'recovery' THEN 'Other' ELSE line_of_defense END AS lod_name,
  CASE WHEN quantity = 50 THEN 99 ELSE lod_numeric END AS lod_numeric FROM controls)"""


@query(
    "drop_audit",
    """SELECT count(*) AS rows_in, count(*) FILTER (lod_name = 'Other') AS other, count(*) FILTER (lod_numeric = 99) AS code_99, count(*) FILTER (lod_name = 'Other' AND lod_numeric = 99) AS both,
    count(*) FILTER (lod_name = 'Other' OR lod_numeric = 99) AS dropped, count(*) FILTER (NOT (lod_name = 'Other' OR lod_numeric = 99)) AS rows_out FROM cascade_rows""",
    CONTROLS,
    _CASCADE,
)
def drop_audit(spark, sf):
    return profiling.drop_audit(_cascade_rows(spark, sf))


@query("cascade_base", "SELECT incident_id, control_id, side, lod_name, lod_numeric, CAST(barrier_failed AS INTEGER) AS y_fail FROM cascade_rows WHERE lod_name <> 'Other' AND lod_numeric <> 99", CONTROLS, _CASCADE)
def cascade_base(spark, sf):
    rows = _cascade_rows(spark, sf).where("lod_name != 'Other' and lod_numeric != 99").withColumn("y_fail", F.col("barrier_failed").cast("int"))
    columns = ["incident_id", "control_id", "side", "lod_name", "lod_numeric", "y_fail"]
    return profiling.contract(rows.select(*columns), columns)


@query(
    "base_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) FILTER ({c} IS NULL) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(avg({c}), 6) AS mean FROM controls" for c in ("quantity", "lod_numeric", "supporting_text_count")),
    CONTROLS,
)
def base_profile(spark, sf):
    return profiling.base_profile(controls(spark, sf, named=False), ["quantity", "lod_numeric", "supporting_text_count"]).withColumn("mean", F.round("mean", 6))

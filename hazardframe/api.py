"""What the service answers, as functions over DataFrames."""

from __future__ import annotations

import hmac
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import cascade, context, mining, retrieval
from .operators.providers import LanguageModel

GONE = {"predict", "explain"}


def check_conditioning(barriers: DataFrame, control_id: str) -> None:
    """A scenario must hold the conditioning barrier."""
    if barriers.where(F.col("control_id") == control_id).isEmpty():
        raise ValueError(f"control {control_id!r} is not in the scenario")


def predict_cascading(barriers: DataFrame, threats: DataFrame, conditioning: str, score: Callable[[DataFrame], DataFrame], factors: DataFrame | None = None) -> DataFrame:
    """Probability and band of every other barrier, given that one has failed; `score` adds column p to the feature rows."""
    check_conditioning(barriers, conditioning)
    rows = cascade.scenario_features(barriers, threats, factors).where(F.col("control_id_cond") == conditioning)
    return score(rows).select("incident_id", F.col("control_id_target").alias("control_id"), "p", cascade.risk_band(F.col("p")).alias("band")).orderBy(F.desc("p"), "control_id")


def rank_targets(barriers: DataFrame, threats: DataFrame, conditioning: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return cascade.ranked(predict_cascading(barriers, threats, conditioning, score).drop("band"), "p")


def explain_cascading(hits: DataFrame, queries: DataFrame, incidents: DataFrame, most: int = retrieval.MOST_CONTEXT) -> DataFrame:
    """Evidence for barrier pairs: (query_id, context, n_conditioning, n_target, empty, n_snippets, n_incidents, recommendations, pif_tags).

    hits: those of `retrieval.pair_hits`, with entry. incidents: incident_id,
    recommendations (list) and pif_tags (map of lists). Recommendations are the
    first five that differ, conditioning hits first; tags are united by category.
    """
    texts = retrieval.pair_context(hits, queries, most)
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n_snippets"), F.count_distinct("incident_id").alias("n_incidents"))
    place = F.when(F.col("side_of_pair") == "conditioning", 0).otherwise(1_000_000) + F.col("place")
    met = hits.select("query_id", "incident_id", place.alias("pos")).join(incidents.select("incident_id", "recommendations", "pif_tags"), "incident_id")
    advice = context.ordered_recommendations(met.select("query_id", "pos", "recommendations"), ["query_id"])
    each = met.select("query_id", F.explode("pif_tags").alias("category", "tags")).groupBy("query_id", "category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    tags = each.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "tags")))).alias("pif_tags"))
    out = texts.join(counts, "query_id", "left").na.fill(0, ["n_snippets", "n_incidents"])
    return out.join(advice, "query_id", "left").join(tags, "query_id", "left")


def check_route(name: str) -> None:
    """Routes that were withdrawn answer 410."""
    if name in GONE:
        raise ServiceError(410, f"{name} was withdrawn; use predict-cascading or explain-cascading")


def apriori_rules(items: DataFrame) -> DataFrame:
    return mining.in_rule_order(mining.association_rules(items))


class ServiceError(Exception):
    """A failure with the status that the service answers."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


def synthesis_prompt(template: str, facts: dict[str, str], top_features: list[tuple[str, float]], contexts: list[tuple[str, str, str]]) -> str:
    """The template with its {name} fields filled; features as signed lines, contexts (incident, summary, failure) as tagged ones."""
    features = "\n".join(f"- {name}: {value:+.3f}" for name, value in top_features) or "No SHAP data available"
    lines = "\n".join(f"<rag_incident_contexts>Incident {i}: {s}" + (f" | Barrier failure: {f}" if f else "") + "</rag_incident_contexts>" for i, s, f in contexts) or "No historical context available"
    for name, value in {**facts, "shap_features_formatted": features, "rag_contexts_formatted": lines}.items():
        template = template.replace("{" + name + "}", str(value))
    return template


def narrative_synthesis(prompt: str, model: LanguageModel | None, timeout: float = 10.0) -> str:
    """A short narrative. 503 without a model or if it fails, 504 if it takes too long, 502 if the answer breaks the limits."""
    if model is None:
        raise ServiceError(503, "no model is loaded")
    pool = ThreadPoolExecutor(1)
    try:
        answer = pool.submit(model.extract, prompt).result(timeout).strip()
    except FutureTimeout as e:
        raise ServiceError(504, "the narrative took too long") from e
    except Exception as e:
        raise ServiceError(503, "the model failed") from e
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    if not answer or len(answer.split()) > 60 or sum(answer.count(c) for c in ".!?") > 4:
        raise ServiceError(502, "no narrative within the limits")
    return answer


def check_key(given: str | None, wanted: str | None) -> None:
    """Requests need the service's key where one is set."""
    if wanted and not hmac.compare_digest(given or "", wanted):
        raise ServiceError(401, "a valid key is needed")


def health(**parts: object) -> dict[str, object]:
    return {"status": "ok" if all(parts.values()) else "degraded", "parts": {k: bool(v) for k, v in parts.items()}}


def clean_request(value: Column, most: int = 2000) -> Column:
    return text.sanitize_prompt(F.substring(F.coalesce(value, F.lit("")), 1, most))


def key_figures(metrics: dict) -> dict[str, str]:
    """What an overview shows of a fleet's metrics."""
    share = lambda k: f"{metrics.get(k) or 0:.1%}"
    named = {"prevention": "average_prevention_coverage", "mitigation": "average_mitigation_coverage", "overall": "average_overall_coverage"}
    return {"incidents": str(metrics.get("total_incidents") or 0), **{k: share(c) for k, c in named.items()}}


def _field(rows: DataFrame, *names: str):
    """The first of several columns that is there and not empty, as text."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _analytics(rows: DataFrame, path: str, kind: str):
    """A value of the nested analytics, null where a layout lacks it."""
    whole = F.to_json("analytics") if "analytics" in rows.columns else F.lit(None).cast("string")
    return F.from_json(F.get_json_object(whole, f"$.{path}"), kind) if kind.startswith("array") else F.get_json_object(whole, f"$.{path}").cast(kind)


GAP = "array<struct<missing_barrier_id:string,id:string,name:string,type:string,description:string>>"


def incident_list(rows: DataFrame) -> DataFrame:
    """(incident_id, label, prevention, mitigation, n_gaps) of processed incidents, by id."""
    label = F.concat(F.col("incident_id"), F.lit(" - "), F.coalesce(_field(rows, "title"), F.substring(F.coalesce(_field(rows, "description"), F.lit("")), 1, 40)))
    gaps = F.coalesce(F.size(_analytics(rows, "gaps", GAP)), F.lit(0))
    cover = [_analytics(rows, f"coverage.{k}_coverage", "double").alias(k) for k in ("prevention", "mitigation")]
    return rows.select("incident_id", label.alias("label"), *cover, F.greatest(gaps, F.lit(0)).alias("n_gaps")).orderBy("incident_id")


def incident_details(rows: DataFrame, incident_id: str) -> dict:
    """One incident as an explorer shows it; 404 where there is none."""
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    gaps = F.transform(
        _analytics(rows, "gaps", GAP),
        lambda g: F.struct(F.initcap(F.coalesce(g["type"], F.lit("unknown"))).alias("type"), F.coalesce(g["name"], g["missing_barrier_id"], g["id"], F.lit("Unknown")).alias("name"), F.coalesce(g["description"], F.lit("No description")).alias("description")),
    )
    found = rows.where(F.col("incident_id") == incident_id).select(
        "incident_id", F.coalesce(_field(rows, "title"), F.substring(_field(rows, "description"), 1, 50), F.lit("No description")).alias("title"), F.coalesce(_field(rows, "description"), F.lit("No description available")).alias("description"),
        unknown(_field(rows, "date")).alias("date"), unknown(_field(rows, "location")).alias("location"), unknown(_field(rows, "severity", "potential_severity")).alias("severity"),
        *[_analytics(rows, f"coverage.{k}_coverage", "double").alias(k) for k in ("prevention", "mitigation")], F.coalesce(gaps, F.array()).alias("gaps"),
    )
    one = found.head()
    if one is None:
        raise ServiceError(404, f"incident {incident_id!r} is not there")
    return one.asDict(recursive=True)

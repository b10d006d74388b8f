"""Queries over embeddings: search, hybrid ranking, pair context, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..operators import retrieval, vector_index
from ..session import work_folder
from ..sources import files, npy
from .registry import query, table

_V = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
 q AS (SELECT vec_id AS query_id, e AS qe, label AS qlabel FROM v WHERE vec_id % 100 = 0)"""


def _ranked(name: str, where: str, on: str = "true") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (
      SELECT query_id, vec_id AS item_id, label, round(list_dot_product(qe, e), 6) AS score FROM q, v WHERE {where} AND {on})))"""


_B, _I, _A = _ranked("b", "vec_id >= 100"), _ranked("i", "vec_id < 100"), _ranked("a", "true")
_M = _ranked("m", "true", "label = qlabel AND vec_id % 2 = 0")
_H30 = """h30 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, barrier_rank, item_id) AS INTEGER) AS place FROM (
  SELECT query_id, b.item_id, i.item_id AS incident_id, b.rank AS barrier_rank, b.score AS barrier_sim, i.rank AS incident_rank, i.score AS incident_sim,
    round(1.0::DOUBLE / (60 + b.rank) + 1.0::DOUBLE / (60 + i.rank), 9) AS rrf_score, b.label AS family
  FROM b JOIN i USING (query_id) WHERE b.item_id % 100 = i.item_id AND b.rank <= 150 AND i.rank <= 40)) WHERE place <= 30)"""
_H = "h AS (SELECT * FROM h30 WHERE place <= 10)"
_HITS = [_V, _B, _I, _H30, _H]


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def _queries(spark, sf, v=None):
    v = (_vectors(spark, sf) if v is None else v).where("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _items(spark, sf, v=None):
    v = _vectors(spark, sf) if v is None else v
    return v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec"), F.col("label").alias("family"), (F.col("vec_id") % 2 == 0).alias("failed_human"))


def _indexed(spark, sf, v=None):
    """Both indexes of a hybrid search: the vectors from 100 on are barriers, the others their incidents."""
    key = F.col("item_id")
    return _items(spark, sf, v).withColumns({"side": F.when(key >= 100, retrieval.BARRIER).otherwise(retrieval.INCIDENT), "incident_id": key % 100})


def _hybrid(spark, sf, k=10):
    v = _vectors(spark, sf)
    return retrieval.hybrid_search(_queries(spark, sf, v), _indexed(spark, sf, v), 150, 40, k)


@query("vector_norm_check", "SELECT count(*) AS vectors, count(*) FILTER (abs(sqrt(list_dot_product(e, e)) - 1) > 1e-4) AS not_unit FROM v", _V)
def vector_norm_check(spark, sf):
    return retrieval.check_unit(table(spark, sf, "embeddings"))


@query("vector_topk", "SELECT query_id, item_id, score, rank FROM a WHERE rank <= 50", _V, _A)
def vector_topk(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.top_k(_queries(spark, sf, v), _items(spark, sf, v), 50)


@query("indexed_topk", "SELECT query_id, item_id, score, rank FROM a WHERE rank <= 10", _V, _A)
def indexed_topk(spark, sf):
    """The same answers as a scan, from a stored index whose cells are ruled out by their bounds."""
    v, path = _vectors(spark, sf), work_folder(spark, "index")
    vector_index.build(_items(spark, sf, v).select("item_id", "item_vec"), path)
    return vector_index.search(spark, path, _queries(spark, sf, v), 10)[0]


@query("npy_vectors", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, len(embedding) AS width FROM embeddings")
def npy_vectors(spark, sf):
    """Vectors written as .npy files in the order of their ids, read back by ranges, and met with their rows by place."""
    path, v = work_folder(spark, "matrix"), _vectors(spark, sf)
    npy.write_npy(v, path, "embedding", ["vec_id"])
    spark.dataSource.register(npy.NpySource)
    matrix = spark.read.format("npy").option("partBytes", 1 << 16).load(path)
    met = npy.positional(matrix, files.ordered(v.select("vec_id"), ["vec_id"], work_folder(spark, "ids"), "row"))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return met.select("row", "vec_id", F.round(total, 6).alias("total"), F.size("vector").alias("width"))


@query("masked_topk", "SELECT query_id, item_id, score, rank FROM m WHERE rank <= 50", _V, _M)
def masked_topk(spark, sf):
    masks = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    queries = masks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("family"), F.lit(True).alias("failed_human"))
    return retrieval.top_k(queries, _items(spark, sf), 50)


@query("hybrid_rrf", "SELECT query_id, item_id, incident_id, barrier_rank, incident_rank, barrier_sim, incident_sim, rrf_score, place FROM h", *_HITS)
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf)


@query(
    "hybrid_domain_dedup",
    """SELECT query_id, item_id, incident_id, rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, incident_id ORDER BY rrf_score DESC, place) AS n FROM h
    WHERE incident_id % 4 = 0 OR (incident_id % 4 = 2 AND incident_id % 3 = 0) OR incident_id % 4 = 3) WHERE n = 1""",
    *_HITS,
)
def hybrid_domain_dedup(spark, sf):
    k = F.col("incident_id") % 4
    agency = F.when(k == 0, "bsee").when(k == 1, "CSB").otherwise("")
    region = F.when(k == 2, F.when(F.col("incident_id") % 3 == 0, "Gulf of Mexico").otherwise("Texas")).otherwise("")
    return retrieval.best_per_incident(_hybrid(spark, sf).where(retrieval.in_domain(agency, region))).select("query_id", "item_id", "incident_id", "rrf_score")


@query("confidence_gate", "SELECT query_id, max(barrier_sim) AS best_sim, CASE WHEN max(barrier_sim) < 0.25 THEN 'No matching incidents found.' ELSE '' END AS message FROM h GROUP BY 1", *_HITS)
def confidence_gate(spark, sf):
    return retrieval.confidence_gate(_hybrid(spark, sf))


@query(
    "rerank",
    """SELECT query_id, item_id, rerank_place FROM (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CASE WHEN item_id % 3 > 0 THEN (item_id % 7) / 7.0::DOUBLE END, 0) DESC, rrf_score DESC, place) AS INTEGER) AS rerank_place FROM h30)
    WHERE rerank_place <= 10""",
    *_HITS,
)
def rerank(spark, sf):
    """Thirty candidates are fetched for a reranker, the best ten stay."""
    scored = _hybrid(spark, sf, 30).withColumn("rerank_score", F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 7) / F.lit(7.0)))
    return retrieval.rerank(scored).select("query_id", "item_id", "rerank_place")


_PAIR = """c AS (SELECT query_id, vec_id AS item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qe, e), 6) DESC, vec_id) AS INTEGER) AS rank FROM q, v WHERE vec_id >= 100 AND vec_id % 2 = 0),
 sides AS (SELECT 'conditioning' AS side_of_pair, query_id, c.item_id, i.item_id AS incident_id, c.rank AS barrier_rank, i.rank AS incident_rank, round(1.0::DOUBLE / (60 + c.rank) + 1.0::DOUBLE / (60 + i.rank), 9) AS rrf_score
   FROM c JOIN i USING (query_id) WHERE c.item_id % 100 = i.item_id AND c.rank <= 150 AND i.rank <= 40
  UNION ALL SELECT 'target', query_id, b.item_id, i.item_id, b.rank, i.rank, round(1.0::DOUBLE / (60 + b.rank) + 1.0::DOUBLE / (60 + i.rank), 9) FROM b JOIN i USING (query_id) WHERE b.item_id % 100 = i.item_id AND b.rank <= 150 AND i.rank <= 40),
 ten AS (SELECT *, row_number() OVER (PARTITION BY query_id, side_of_pair ORDER BY rrf_score DESC, barrier_rank, item_id) AS p FROM sides QUALIFY p <= 10),
 kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, side_of_pair, incident_id ORDER BY rrf_score DESC, p) AS n FROM ten WHERE incident_id % 4 = 0 OR (incident_id % 4 = 2 AND incident_id % 3 = 0) OR incident_id % 4 = 3 QUALIFY n = 1),
 pair_hits AS (SELECT * EXCLUDE (p, n), CAST(row_number() OVER (PARTITION BY query_id, side_of_pair ORDER BY p) AS INTEGER) AS place FROM kept)"""


def _incident_facts(spark, sf):
    """Publisher and region of the incident side: some are known by publisher, others by region or not at all."""
    ids = table(spark, sf, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("incident_id"))
    k = F.col("incident_id") % 4
    agency = F.when(k == 0, "bsee").when(k == 1, "CSB").otherwise("")
    region = F.when(k == 2, F.when(F.col("incident_id") % 3 == 0, "Gulf of Mexico").otherwise("Texas")).otherwise("")
    return ids.select("incident_id", agency.alias("agency"), region.alias("region"))


def _pair_hits(spark, sf):
    queries = _queries(spark, sf)
    items = _indexed(spark, sf).withColumn("failed_human", (F.col("side") == retrieval.INCIDENT) | F.col("failed_human"))
    conditioning = retrieval.hybrid_search(queries.withColumn("failed_human", F.lit(True)), items, 150, 40)
    target = retrieval.hybrid_search(queries, items, 150, 40)
    return retrieval.pair_hits(conditioning, target, _incident_facts(spark, sf))


@query("pair_hits", "SELECT query_id, side_of_pair, item_id, incident_id, barrier_rank, incident_rank, rrf_score, place FROM pair_hits", *_HITS, _PAIR)
def pair_hits(spark, sf):
    return _pair_hits(spark, sf).select("query_id", "side_of_pair", "item_id", "incident_id", "barrier_rank", "incident_rank", "rrf_score", "place")


_ENTRY = """printf('### Result %d (RRF: %.4f, Barrier Rank: %d, Incident Rank: %d)\n**Barrier:** barrier %d\n**Family:** f%d | Side: prevention | Status: failed\n**Role:** \n**LOD Basis:** N/A\n**Human Failed:** %s | Human Contribution: N/A\n**Evidence:**\n%s\n\n**Parent Incident:** %d\n**Incident Summary:** summary %d\n%s%s',
   place, rrf_score, barrier_rank, incident_rank, item_id, item_id % 5, CASE WHEN item_id % 2 = 0 THEN 'Yes' ELSE 'No' END, CASE WHEN item_id % 3 = 0 THEN '- "quote one"\n- "quote two"' ELSE '- N/A' END, incident_id, incident_id,
   CASE WHEN incident_id % 5 = 0 THEN '**Recommendations:**\n- ' || repeat('inspect ', 60) || '\n' ELSE '' END,
   CASE WHEN incident_id % 7 = 0 THEN '**Performance Influencing Factors (negative):**\n- People: situational awareness\n- Organisation: safety culture, training\n' ELSE '' END)"""
_CONTEXT = f"""entries AS (SELECT query_id, side_of_pair, place, {_ENTRY} AS entry FROM pair_hits),
 running AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id, side_of_pair ORDER BY place) AS used FROM entries),
 cut AS (SELECT *, min(CASE WHEN used > 3000 - 29 AND place > 1 THEN place END) OVER (PARTITION BY query_id, side_of_pair) AS stop FROM running),
 texts AS (SELECT query_id, s.side_of_pair, coalesce('## Similar Barrier Failures\n\n' || string_agg(entry, '\n---\n' ORDER BY place) FILTER (stop IS NULL OR place < stop), '## Similar Barrier Failures\n\nNo similar barrier failures found.') AS t
   FROM q CROSS JOIN (VALUES ('conditioning'), ('target')) AS s(side_of_pair) LEFT JOIN cut USING (query_id, side_of_pair) GROUP BY 1, 2),
 counts AS (SELECT query_id, count(*) FILTER (side_of_pair = 'conditioning') AS n_conditioning, count(*) FILTER (side_of_pair = 'target') AS n_target FROM pair_hits GROUP BY 1)"""


@query(
    "pair_context",
    """SELECT query_id, digest, coalesce(n_conditioning, 0) AS n_conditioning, coalesce(n_target, 0) AS n_target FROM (SELECT query_id, sha256('## Conditioning Barrier — Similar Failures\n\n' || max(CASE WHEN side_of_pair = 'conditioning' THEN t END)
      || '\n\n## Target Barrier — Similar Failures\n\n' || max(CASE WHEN side_of_pair = 'target' THEN t END)) AS digest FROM texts GROUP BY 1) LEFT JOIN counts USING (query_id)""",
    *_HITS,
    _PAIR,
    _CONTEXT,
)
def pair_context(spark, sf):
    item, inc = F.col("item_id"), F.col("incident_id")
    none = F.array().cast("array<string>")
    tags = F.create_map(F.lit("people"), F.array(F.lit("situational_awareness")), F.lit("organisation"), F.array(F.lit("safety_culture"), F.lit("training")))
    columns = {
        "barrier_name": F.concat(F.lit("barrier "), item.cast("string")), "barrier_family": F.concat(F.lit("f"), (item % 5).cast("string")), "side": F.lit("prevention"), "barrier_status": F.lit("failed"),
        "barrier_role": F.lit(""), "lod_basis": F.lit("N/A"), "barrier_failed_human": item % 2 == 0, "human_contribution_value": F.lit(None).cast("string"),
        "supporting_text": F.when(item % 3 == 0, F.array(F.lit("quote one"), F.lit("quote two"))).otherwise(none), "incident_summary": F.concat(F.lit("summary "), inc.cast("string")),
        "recommendations": F.when(inc % 5 == 0, F.array(F.repeat(F.lit("inspect "), F.lit(60)))).otherwise(none), "pif_tags": F.when(inc % 7 == 0, tags),
    }
    hits = _pair_hits(spark, sf).withColumn("entry", retrieval.context_entry(F.col("place"), columns))
    found = retrieval.pair_context(hits, _queries(spark, sf), 3000)
    return found.select("query_id", F.sha2("context", 256).alias("digest"), "n_conditioning", "n_target")


@query(
    "explain_cascading",
    """SELECT query_id, n_conditioning, n_target, n_snippets, n_incidents, empty, coalesce((SELECT string_agg(rec, '|' ORDER BY n) FROM (SELECT query_id AS qid, rec, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS n FROM (
        SELECT query_id, rec, side_of_pair || lpad(CAST(place AS VARCHAR), 4, '0') || i AS pos FROM (SELECT query_id, side_of_pair, place, unnest(['r' || (incident_id % 7), 'r' || (incident_id % 5)]) AS rec, unnest([1, 2]) AS i FROM pair_hits)) GROUP BY query_id, rec)
      WHERE qid = query_id AND n <= 5), '') AS recommendations,
    CASE WHEN people OR work THEN '{' || array_to_string(list_filter([CASE WHEN people THEN '"people":["fatigue"]' END, CASE WHEN work THEN '"work":["procedures","workload"]' END], lambda x: x IS NOT NULL), ',') || '}' END AS pif_tags
    FROM (SELECT q.query_id, count(item_id) FILTER (side_of_pair = 'conditioning') AS n_conditioning, count(item_id) FILTER (side_of_pair = 'target') AS n_target, count(item_id) AS n_snippets, count(DISTINCT incident_id) AS n_incidents,
      concat_ws(',', CASE WHEN count(item_id) FILTER (side_of_pair = 'conditioning') = 0 THEN 'conditioning' END, CASE WHEN count(item_id) FILTER (side_of_pair = 'target') = 0 THEN 'target' END) AS empty,
      coalesce(bool_or(incident_id % 2 = 0), false) AS people, coalesce(bool_or(incident_id % 3 = 0), false) AS work FROM q LEFT JOIN pair_hits USING (query_id) GROUP BY 1)""",
    *_HITS,
    _PAIR,
)
def explain_cascading(spark, sf):
    """What the service answers for a pair: counts, the first five recommendations and the united tags."""
    key = F.col("incident_id")
    text = lambda n: F.concat(F.lit("r"), (key % n).cast("string"))
    tags = F.map_filter(F.create_map(F.lit("people"), F.when(key % 2 == 0, F.array(F.lit("fatigue"))), F.lit("work"), F.when(key % 3 == 0, F.array(F.lit("workload"), F.lit("procedures")))), lambda k, v: v.isNotNull())
    facts = _incident_facts(spark, sf).select("incident_id", F.array(text(7), text(5)).alias("recommendations"), tags.alias("pif_tags"))
    hits = _pair_hits(spark, sf).withColumn("entry", F.lit("x"))
    found = api.explain_cascading(hits, _queries(spark, sf), facts)
    return found.select("query_id", "n_conditioning", "n_target", "n_snippets", "n_incidents", "empty", F.coalesce(F.array_join("recommendations", "|"), F.lit("")).alias("recommendations"), F.to_json("pif_tags").alias("pif_tags"))


def _expected(spark, sf, v=None):
    return (_vectors(spark, sf) if v is None else v).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("family"))


def _first_hits(spark, sf):
    """The rank of the first of ten hits among the barriers that has the query's own label."""
    v = _vectors(spark, sf)
    hits = retrieval.top_k(_queries(spark, sf, v), _items(spark, sf, v).where("item_id >= 100"), 10, carry=["family"])
    return retrieval.first_match(hits, _expected(spark, sf, v))


def _delta(spark, sf):
    family = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("family"))
    after = _hybrid(spark, sf).join(family, "item_id").select("query_id", "family", F.col("place").alias("rank"))
    return retrieval.ranking_delta(_first_hits(spark, sf), retrieval.first_match(after, _expected(spark, sf)))


_FIRST = """first_b AS (SELECT query_id, min(CASE WHEN label = qlabel AND rank <= 10 THEN rank END) AS rank FROM q LEFT JOIN b USING (query_id) GROUP BY 1),
 first_h AS (SELECT query_id, min(CASE WHEN family = qlabel THEN place END) AS rank FROM q LEFT JOIN h USING (query_id) GROUP BY 1)"""


@query(
    "retrieval_metrics",
    """SELECT count(*) AS queries, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5,
    avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS top10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM first_b""",
    *_HITS,
    _FIRST,
)
def retrieval_metrics(spark, sf):
    return retrieval.retrieval_metrics(_first_hits(spark, sf))


@query(
    "search_evaluation",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS search, count(*) AS queries, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS top10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM {view}"""
        for name, view in (("vectors", "first_b"), ("hybrid", "first_h"))
    ),
    *_HITS,
    _FIRST,
)
def search_evaluation(spark, sf):
    family = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("family"))
    plain = retrieval.top_k(_queries(spark, sf), _items(spark, sf).where("item_id >= 100"), 10, carry=["family"])
    fused = _hybrid(spark, sf).join(family, "item_id").select("query_id", "family", F.col("place").alias("rank"))
    return retrieval.evaluated({"vectors": plain.select("query_id", "family", "rank"), "hybrid": fused}, _expected(spark, sf))


@query(
    "ranking_delta",
    """SELECT query_id, x.rank AS before, y.rank AS after, CASE WHEN x.rank IS NULL AND y.rank IS NULL THEN 'both_miss' WHEN x.rank IS NULL THEN 'new_hit' WHEN y.rank IS NULL THEN 'lost'
    WHEN y.rank < x.rank THEN 'improved' WHEN y.rank > x.rank THEN 'degraded' ELSE 'unchanged' END AS outcome FROM first_b x JOIN first_h y USING (query_id)""",
    *_HITS,
    _FIRST,
)
def ranking_delta(spark, sf):
    return _delta(spark, sf)


@query(
    "ranking_delta_summary",
    """SELECT count(*) FILTER (coalesce(y.rank < x.rank, y.rank IS NOT NULL AND x.rank IS NULL)) AS improved, count(*) FILTER (coalesce(y.rank > x.rank, y.rank IS NULL AND x.rank IS NOT NULL)) AS degraded,
    count(*) FILTER (x.rank IS NOT DISTINCT FROM y.rank) AS unchanged, coalesce(round(avg(x.rank - y.rank), 6), 0) AS mean_gain FROM first_b x JOIN first_h y USING (query_id)""",
    *_HITS,
    _FIRST,
)
def ranking_delta_summary(spark, sf):
    return retrieval.delta_summary(_delta(spark, sf))


@query("latency_stats", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events")
def latency_stats(spark, sf):
    return retrieval.latency_stats(table(spark, sf, "events"), "value")

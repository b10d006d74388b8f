"""Vector search, hybrid ranking, context and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text, vector
from .metrics import percentiles

#: Queries that go with every task that scores items, and queries and items of a cell beyond that.
QUERY_BLOCK, ITEM_BLOCK = 4096, 1 << 16
# Publishers and regions that count as the domain.
DOMAIN_AGENCIES = ["BSEE", "TSB", "PHMSA"]
DOMAIN_REGIONS = ["gulf", "offshore", "north sea", "alaska"]
NO_MATCH = "No matching incidents found."


def check_unit(vectors: DataFrame, column: str = "embedding", tolerance: float = 1e-4) -> DataFrame:
    """One row: vectors, and those whose length is not 1 within the tolerance."""
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(F.abs(vector.norm(F.col(column)) - 1) > tolerance).alias("not_unit"))


class _Best:
    """The k best items of each query and side so far: largest score, then least id."""

    def __init__(self, queries: int, most: list[int]):
        self.sides, self.most = len(most), np.tile(most, queries)
        self.floor = np.full(len(self.most), -np.inf)
        self.held: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, allowed: np.ndarray | None, side: np.ndarray, columns: list[np.ndarray]) -> None:
        """scores: queries x items; columns: id first, then what is carried, one value an item."""
        slot = np.arange(len(scores))[:, None] * self.sides + side[None, :]
        good = scores >= self.floor[slot]
        q, i = np.nonzero(good if allowed is None else good & allowed)
        self.held.append([slot[q, i], scores[q, i], *(c[i] for c in columns)])
        self.waiting += len(q)
        if self.waiting > 4 * int(self.most.sum()) + 100_000:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        if not self.held:
            return []
        rows = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        first = np.concatenate([[True], rows[0][1:] != rows[0][:-1]]) if len(order) else np.zeros(0, bool)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        kept = place < self.most[rows[0]]
        rows, place = [c[kept] for c in rows], place[kept]
        last = place == self.most[rows[0]] - 1
        self.floor[rows[0][last]] = rows[1][last]
        self.held, self.waiting = [rows], len(rows[0])
        return rows


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _values(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object)


def _scored(tables: Iterator[pa.Table], queries: pa.Table, masks: list[str], carry: list[str], sides: dict, digits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The best items of each query among those of some tables: blocks of items against all queries by a matrix product."""
    q, names = _vectors(queries.column("query_vec").combine_chunks()), list(sides)
    wanted = {m: _values(queries.column(m)) for m in masks}
    best = _Best(len(q), list(sides.values()))
    for table in tables:
        for at in range(0, table.num_rows, 2048):
            part = table.slice(at, 2048)
            x = _vectors(part.column("item_vec").combine_chunks() if isinstance(part, pa.Table) else part.column("item_vec"))
            if not len(q) or not len(x):
                continue
            allowed = None
            for m in masks:
                mine = _values(part.column(m))
                here = np.array([w is None for w in wanted[m]])[:, None] | (wanted[m][:, None] == mine[None, :])
                allowed = here if allowed is None else allowed & here
            side = np.array([names.index(s) for s in part.column("side").to_pylist()]) if "side" in schema.names else np.zeros(len(x), int)
            best.add(np.round(q @ x.T, digits), allowed, side, [np.array(part.column(c).to_pylist()) for c in ("item_id", *carry)])
    rows = best.settle()
    if rows:
        ids, slot = queries.column("query_id").to_pylist(), rows[0]
        out = [pa.array([ids[k] for k in (slot // len(names)).tolist()]), pa.array(rows[1]), *(pa.array(c.tolist()) for c in rows[2:])]
        out += [pa.array([names[k] for k in (slot % len(names)).tolist()])] if "side" in schema.names else []
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _best_of_tasks(queries: DataFrame, items: DataFrame, k: int | dict[str, int], digits: int, carry: list[str]) -> tuple[DataFrame, list[str]]:
    """(query_id, score, item_id, carried columns, side): what each task of `top_k` keeps, and the name of the side if there is one."""
    carry, sides = list(carry), k if isinstance(k, dict) else {"": k}
    masks = [c for c in queries.columns if c not in ("query_id", "query_vec")]
    kinds = {**dict(items.dtypes), "query_id": dict(queries.dtypes)["query_id"], "score": "double"}
    names = ["query_id", "score", "item_id", *carry, *(["side"] if isinstance(k, dict) else [])]
    ddl = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    items = items.select("item_id", "item_vec", *masks, *[c for c in (*carry, *names[3 + len(carry) :]) if c not in masks])
    small = queries.limit(QUERY_BLOCK + 1).toArrow()
    if small.num_rows <= QUERY_BLOCK:
        found = items.mapInArrow(lambda it: _scored((pa.Table.from_batches([b]) for b in it), small, masks, carry, sides, digits, schema), ddl)
    else:
        across, down = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERY_BLOCK), (items, ITEM_BLOCK)))
        cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).alias
        every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
        q = queries.select("*", cell("query_id", across)("qb"), every(down, "ib")).groupBy("qb", "ib")
        i = items.select("*", cell("item_id", down)("ib"), every(across, "qb")).groupBy("qb", "ib")

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(_scored(iter([b]), a, masks, carry, sides, digits, schema)), schema)

        found = q.cogroup(i).applyInArrow(meet, ddl)
    return found, names[3 + len(carry) :]


def top_k(queries: DataFrame, items: DataFrame, k: int | dict[str, int], digits: int = 6, carry: list[str] = ()) -> DataFrame:
    """(query_id, item_id, score, rank, carried columns): the k items with the largest inner product, ties by id.

    queries: query_id, query_vec. items: item_id, item_vec, and mask columns that
    `queries` may share by name: an item must equal each that is not null. With k
    as {side: k}, items have a column `side`, kept in the result, and every side
    has its own ranks. Blocks of items are scored by matrix products, and each
    task keeps k items a query, so what moves is queries x tasks x k rows. Up to
    `QUERY_BLOCK` queries go with the tasks that read the items; more of them meet
    the items in a grid of cells of bounded size.
    """
    found, side = _best_of_tasks(queries, items, k, digits, carry)
    keys = ["query_id", *side]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "item_id"))
    most = F.lit(k) if not isinstance(k, dict) else F.element_at(F.create_map(*[F.lit(x) for p in k.items() for x in p]), F.col("side"))
    ranked = found.repartition("query_id").withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.select("query_id", "item_id", "score", "rank", *carry, *side)


def hybrid(barrier_hits: DataFrame, incident_hits: DataFrame, parent: DataFrame, k: int = 10) -> DataFrame:
    """Barrier hits whose incident is among the incident hits, by reciprocal rank fusion.

    Ranks were given on each side before the two meet. parent: item_id, incident_id.
    """
    b = barrier_hits.join(parent, "item_id").select("query_id", "item_id", "incident_id", F.col("rank").alias("barrier_rank"), F.col("score").alias("barrier_sim"))
    i = incident_hits.groupBy("query_id", F.col("item_id").alias("incident_id")).agg(F.min("rank").alias("incident_rank"), F.max("score").alias("incident_sim"))
    return _fused(b.join(i, ["query_id", "incident_id"]), k)


def _fused(met: DataFrame, k: int) -> DataFrame:
    met = met.withColumn("rrf_score", F.round(vector.rrf(F.col("barrier_rank"), F.col("incident_rank")), 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "barrier_rank", "item_id"))
    return met.withColumn("place", place).where(F.col("place") <= k)


BARRIER, INCIDENT = "barrier", "incident"


def hybrid_search(queries: DataFrame, items: DataFrame, barriers: int = 50, incidents: int = 20, k: int = 10) -> DataFrame:
    """`hybrid` over one table of items with side (barrier or incident) and incident_id, in one pass and one exchange.

    What the tasks kept of a query, `barriers` + `incidents` rows each at most, meets
    once; ranks and fusion are made there in one go.
    """
    most = {BARRIER: barriers, INCIDENT: incidents}
    found, _ = _best_of_tasks(queries, items, most, 6, ["incident_id"])
    kinds = dict(found.dtypes)
    ddl = f"query_id {kinds['query_id']}, incident_id {kinds['incident_id']}, item_id {kinds['item_id']}, barrier_rank int, barrier_sim double, incident_rank int, incident_sim double, rrf_score double, place int"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def fuse(query, rows: list[tuple]) -> list[tuple]:
        sides = {}
        for side, n in most.items():
            ordered = sorted((r for r in rows if r[3] == side), key=lambda r: (-r[0], r[1]))[:n]
            sides[side] = [(rank, *r) for rank, r in enumerate(ordered, 1)]
        parents = {r[2]: r for r in reversed(sides[INCIDENT])}
        met = [(b, parents[b[3]]) for b in sides[BARRIER] if b[3] in parents]
        out = [(query, b[3], b[2], b[0], b[1], i[0], i[1], float(np.round(1 / (60 + b[0]) + 1 / (60 + i[0]), 9))) for b, i in met]
        out.sort(key=lambda r: (-r[7], r[3], r[2]))
        return [(*r, place) for place, r in enumerate(out[:k], 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []
        for batch in batches:
            for query, *row in zip(*(batch.column(c).to_pylist() for c in ("query_id", "score", "item_id", "incident_id", "side")), strict=True):
                if rows and query != held:
                    out += fuse(held, rows)
                    rows = []
                held = query
                rows.append(tuple(row))
        out += fuse(held, rows) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, ddl)


def in_domain(agency: Column, region: Column) -> Column:
    """By publisher if known, else by words of the region, else kept."""
    known = F.coalesce(F.trim(agency), F.lit("")) != ""
    named = F.coalesce(region, F.lit("")) != ""
    return F.when(known, F.upper(F.trim(agency)).isin(DOMAIN_AGENCIES)).when(named, F.lower(region).rlike("|".join(DOMAIN_REGIONS))).otherwise(F.lit(True))


def best_per_incident(hits: DataFrame) -> DataFrame:
    """The hit with the best fused score of each incident; the first wins ties."""
    w = Window.partitionBy("query_id", "incident_id").orderBy(F.desc("rrf_score"), "place")
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def confidence_gate(hits: DataFrame, least: float = 0.25) -> DataFrame:
    """(query_id, best_sim, message): a message where the best barrier similarity is too low."""
    return hits.groupBy("query_id").agg(F.max("barrier_sim").alias("best_sim")).withColumn("message", F.when(F.col("best_sim") < least, NO_MATCH).otherwise(""))


def rerank(hits: DataFrame, k: int = 10) -> DataFrame:
    """By rerank_score, null as 0, then by fused score."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.desc("rrf_score"), "place")
    return hits.withColumn("rerank_place", F.row_number().over(w)).where(F.col("rerank_place") <= k)


def first_match(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank) of the first hit of the expected family, null for none. hits: query_id, family, rank."""
    met = expected.select("query_id", F.col("family").alias("__wanted")).join(hits.select("query_id", "family", "rank"), "query_id", "left")
    return met.groupBy("query_id").agg(F.min(F.when(F.col("family") == F.col("__wanted"), F.col("rank"))).alias("rank"))


def retrieval_metrics(matches: DataFrame) -> DataFrame:
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"top{k}")
    return matches.agg(F.count("*").alias("queries"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def ranking_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, before, after, outcome) of two rankings' first matches."""
    met = before.select("query_id", F.col("rank").alias("before")).join(after.select("query_id", F.col("rank").alias("after")), "query_id", "full")
    b, a = F.col("before"), F.col("after")
    outcome = (
        F.when(b.isNull() & a.isNull(), "both_miss").when(b.isNull(), "new_hit").when(a.isNull(), "lost").when(a < b, "improved").when(a > b, "degraded").otherwise("unchanged")
    )
    return met.withColumn("outcome", outcome)


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row: improved, degraded and unchanged queries, and the mean gain in rank over those that both rankings hit."""
    o = F.col("outcome")
    gain = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), F.col("before") - F.col("after"))
    return delta.agg(
        F.count_if(o.isin("improved", "new_hit")).alias("improved"), F.count_if(o.isin("degraded", "lost")).alias("degraded"), F.count_if(o.isin("unchanged", "both_miss")).alias("unchanged"), F.coalesce(F.round(F.avg(gain), 6), F.lit(0.0)).alias("mean_gain")
    )


def latency_stats(rows: DataFrame, column: str) -> DataFrame:
    whole = rows.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("most"))
    p95 = percentiles(rows, column, {"p95": 0.95}).select(F.round("p95", 6).alias("p95"))
    return whole.join(p95, F.lit(True)).select("n", "mean", "p95", "most")  # one row each


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Rows of each group before the first that overflows the running total; the first row always stays. Adds used."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = rows.withColumns({"used": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.row_number().over(w)})
    stop = F.min(F.when((F.col("used") > most) & (F.col("__n") > 1), F.col("__n"))).over(Window.partitionBy(*keys))
    return run.withColumn("__stop", stop).where("__stop is null or __n < __stop").drop("__n", "__stop")


def fuse_labels(gated: DataFrame, scored: DataFrame) -> DataFrame:
    """Final label: a failed extraction has no score, a missing text says so, else the flag."""
    met = gated.select("doc_id", "status").join(scored, "doc_id", "left")
    ok, found = F.col("status") == "OK", F.col("loc_flag").isNotNull()
    label = F.when(~ok, "EXTRACTION_FAILED").when(~found, "TEXT_FILE_MISSING").when(F.col("loc_flag"), "TRUE").otherwise("FALSE")
    return met.select("doc_id", label.alias("final_label"), F.when(ok & found, F.col("loc_score")).alias("loc_score"))


def with_metadata(hits: DataFrame, metadata: DataFrame, fields: list[str], order: str | None = None) -> DataFrame:
    """Fields by (incident_id, control_id), else those of the first row with the control_id (in `order`, by incident if not given)."""
    exact = hits.join(metadata.select("incident_id", "control_id", F.lit(True).alias("__known"), *[F.col(f).alias(f"__{f}") for f in fields]), ["incident_id", "control_id"], "left")
    first = metadata.groupBy("control_id").agg(F.min_by(F.struct(*fields), order or "incident_id").alias("__first"))
    met = exact.join(first, "control_id", "left")
    return met.select(*hits.columns, *[F.when(F.col("__known"), F.col(f"__{f}")).otherwise(F.col(f"__first.{f}")).alias(f) for f in fields])


# The layout of a context.
CONTEXT_HEADER, CONTEXT_RULE, MOST_CONTEXT = "## Similar Barrier Failures\n\n", "\n---\n", 8000
NO_CONTEXT = CONTEXT_HEADER + "No similar barrier failures found."
CATEGORIES = ["people", "work", "organisation"]


def context_entry(number: Column, columns: dict[str, Column] | None = None) -> Column:
    """One hit as text: its ranks, the barrier, the evidence, and its incident with advice and negative factors.

    columns: rrf_score, barrier_rank, incident_rank, barrier_name, barrier_family,
    side, barrier_status, barrier_role, lod_basis, barrier_failed_human,
    human_contribution_value, supporting_text (list), incident_id,
    incident_summary, recommendations (list), pif_tags (map of lists); by name if not given.
    """
    c = columns or {}
    get = lambda name: c.get(name, F.col(name))
    told = lambda name: F.coalesce(get(name).cast("string"), F.lit(""))
    listed = lambda name: F.coalesce(get(name), F.array().cast("array<string>"))
    quotes = F.when(F.size(listed("supporting_text")) > 0, F.array_join(F.transform(listed("supporting_text"), lambda t: F.concat(F.lit('- "'), t, F.lit('"'))), "\n")).otherwise("- N/A")
    advice = F.when(F.size(listed("recommendations")) > 0, F.concat(F.lit("**Recommendations:**\n"), F.array_join(F.transform(listed("recommendations"), lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n"))).otherwise("")
    line = lambda k: F.when(F.size(F.try_element_at(get("pif_tags"), F.lit(k))) > 0, F.concat(F.lit(f"- {k.title()}: "), F.array_join(F.transform(F.try_element_at(get("pif_tags"), F.lit(k)), lambda f: F.replace(f, F.lit("_"), F.lit(" "))), ", ")))
    lines = F.array_compact(F.array(*map(line, CATEGORIES)))
    factors = F.when(F.size(lines) > 0, F.concat(F.lit("**Performance Influencing Factors (negative):**\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(
        F.format_string("### Result %d (RRF: %s, Barrier Rank: %d, Incident Rank: %d)\n", number, text.fixed(get("rrf_score"), 4), get("barrier_rank"), get("incident_rank")),
        F.lit("**Barrier:** "), told("barrier_name"), F.lit("\n**Family:** "), told("barrier_family"), F.lit(" | Side: "), told("side"), F.lit(" | Status: "), told("barrier_status"),
        F.lit("\n**Role:** "), told("barrier_role"), F.lit("\n**LOD Basis:** "), told("lod_basis"),
        F.lit("\n**Human Failed:** "), F.when(get("barrier_failed_human"), "Yes").otherwise("No"), F.lit(" | Human Contribution: "), F.coalesce(F.nullif(get("human_contribution_value"), F.lit("")), F.lit("N/A")),
        F.lit("\n**Evidence:**\n"), quotes, F.lit("\n\n**Parent Incident:** "), told("incident_id"), F.lit("\n**Incident Summary:** "), told("incident_summary"), F.lit("\n"), advice, factors,
    )


def context_text(hits: DataFrame, queries: DataFrame, keys: list[str], most: int = MOST_CONTEXT) -> DataFrame:
    """(keys, context) of every row of `queries`: entries by place until one would pass `most` characters, header included; the first always stays.

    hits: keys, place, entry. The rule between entries does not count.
    """
    sized = hits.withColumn("size", F.length("entry").cast("long"))
    kept = within_budget(sized, keys, ["place"], "size", most - len(CONTEXT_HEADER))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), CONTEXT_RULE)
    built = kept.groupBy(*keys).agg(F.concat(F.lit(CONTEXT_HEADER), joined).alias("context"))
    return queries.select(*keys).join(built, keys, "left").select(*keys, F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def explained(hits: DataFrame, queries: DataFrame, metadata: DataFrame, incidents: DataFrame, k: int = 10, most: int = MOST_CONTEXT, reranked: bool = False) -> DataFrame:
    """(query_id, context) of a hybrid search: candidates cut to k (by rerank_score if there is a reranker), with what is known of barrier and incident.

    hits: those of `hybrid` or `hybrid_search`, asked for 30 candidates where a
    reranker follows, with control_id. metadata: incident_id, control_id and the
    barrier's fields; incidents: incident_id, incident_summary, recommendations, pif_tags.
    """
    kept = rerank(hits, k).drop("place").withColumnRenamed("rerank_place", "place") if reranked else hits.where(F.col("place") <= k)
    fields = ["barrier_name", "barrier_family", "side", "barrier_status", "barrier_role", "lod_basis", "barrier_failed_human", "human_contribution_value", "supporting_text"]
    known = with_metadata(kept, metadata, fields).join(incidents, "incident_id", "left")
    return context_text(known.withColumn("entry", context_entry(F.col("place"))), queries, ["query_id"], most)


def evaluated(searches: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """(search, queries, top1, top5, top10, mrr) of several rankings of the same queries. searches: name to hits (query_id, family, rank)."""
    out = None
    for name, hits in searches.items():
        row = retrieval_metrics(first_match(hits, expected)).select(F.lit(name).alias("search"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def pair_hits(conditioning: DataFrame, target: DataFrame, incidents: DataFrame) -> DataFrame:
    """Both sides' hits of a barrier pair, each side kept to the domain and to its best hit of each incident, under one another.

    conditioning, target: query_id, item_id, incident_id, rrf_score, place; the
    conditioning search has asked for barriers that failed by human factors.
    incidents: incident_id, agency, region; a hit of an unknown incident passes.
    Adds side_of_pair and numbers the hits of each side anew.
    """
    sides = conditioning.withColumn("side_of_pair", F.lit("conditioning")).unionByName(target.withColumn("side_of_pair", F.lit("target")))
    known = incidents.select("incident_id", in_domain(F.col("agency"), F.col("region")).alias("__in"))
    good = sides.join(known, "incident_id", "left").where(F.coalesce("__in", F.lit(True))).drop("__in")
    keys = ["query_id", "side_of_pair"]
    good = good.repartition(*keys)  # dealt anew after the union, for both windows below
    best = F.row_number().over(Window.partitionBy(*keys, "incident_id").orderBy(F.desc("rrf_score"), "place"))
    once = good.withColumn("__n", best).where("__n = 1").drop("__n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("place")))


def pair_context(hits: DataFrame, queries: DataFrame, most: int = MOST_CONTEXT) -> DataFrame:
    """(query_id, context, n_conditioning, n_target, empty): both sides' contexts under their headings. hits: those of `pair_hits`, with entry."""
    both = queries.select("query_id", F.explode(F.array(F.lit("conditioning"), F.lit("target"))).alias("side_of_pair"))
    texts = context_text(hits, both, ["query_id", "side_of_pair"], most)
    counts = hits.groupBy("query_id").agg(*[F.count_if(F.col("side_of_pair") == s).alias(f"n_{s}") for s in ("conditioning", "target")])
    one = lambda s: F.max(F.when(F.col("side_of_pair") == s, F.col("context")))
    heading = lambda s: F.lit(f"## {s.title()} Barrier — Similar Failures\n\n")
    merged = texts.groupBy("query_id").agg(F.concat(heading("conditioning"), one("conditioning"), F.lit("\n\n"), heading("target"), one("target")).alias("context"))
    met = merged.join(counts, "query_id", "left").na.fill(0, ["n_conditioning", "n_target"])
    empty = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{s}") == 0, s) for s in ("conditioning", "target")])), ",")
    return met.withColumn("empty", empty)


def citations(hits: DataFrame, most: int = 500) -> DataFrame:
    return hits.withColumn("citation", F.substring(F.coalesce(F.try_element_at("supporting_text", F.lit(1)), F.lit("")), 1, most))

"""What goes with an answer: factor tags, recommendations, display names, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocabulary import CONDITIONS, FACTORS, PIFS


def negative_factors(value) -> dict[str, Column]:
    """For each category the sorted factors whose value is 'negative'. value(category, factor) gives the value's column."""
    return {c: F.array_compact(F.array(*[F.when(value(c, f) == "negative", F.lit(f)) for f in sorted(names)])) for c, names in FACTORS.items()}


def factor_value(category: str, factor: str) -> Column:
    return F.col(f"pif_{factor}_value")


def pif_tags(value=factor_value) -> Column:
    """A map from category to its negative factors, without categories that have none; null if no factor is negative."""
    found = negative_factors(value)
    tags = F.map_filter(F.create_map(*[x for c, t in found.items() for x in (F.lit(c), t)]), lambda k, v: F.size(v) > 0)
    return F.when(F.size(tags) > 0, tags)


def factor_tags(incidents: DataFrame, keys: list[str], value=factor_value) -> DataFrame:
    """(keys, category, tags): sorted factors that are negative in any incident of the group; groups without any are left out."""
    def named(category: str, tags: Column) -> Column:
        return F.transform(tags, lambda x: F.struct(F.lit(category).alias("category"), x.alias("tag")))

    pairs = F.explode(F.flatten(F.array(*[named(c, t) for c, t in negative_factors(value).items()]))).alias("t")
    return incidents.select(*keys, pairs).select(*keys, "t.*").groupBy(*keys, "category").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def factor_notes(value=factor_value) -> Column:
    """The values that are not blank, trimmed, in the factors' fixed order."""
    clean = [F.nullif(text.strip(value(c, f).cast("string")), F.lit("")) for c, names in FACTORS.items() for f in names]
    return F.array_compact(F.array(*clean))


def ordered_recommendations(rows: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The first distinct recommendations of each group, by first position. rows: keys, pos, recommendations.

    Places beyond `most` are cut in each partition before they move, so no
    group's recommendations ever gather in a task.
    """
    each = rows.select(*keys, "pos", F.posexplode("recommendations").alias("inner", "rec")).withColumn("rec", text.strip(F.col("rec"))).where("rec != ''")
    first = each.groupBy(*keys, "rec").agg(F.min(F.struct("pos", "inner")).alias("at"))
    placed = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "rec"))).where(F.col("n") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "rec"))), lambda x: x["rec"])
    return placed.groupBy(*keys).agg(ordered.alias("recommendations"))


def condition(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(status, F.lit(""))), F.lit("status_unknown"))


def display_names(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """`column` with its display name, or as it is. names: raw, display (a configuration table)."""
    met = df.join(names.select(F.col("raw").alias("__raw"), F.col("display").alias("__display")), F.col(column) == F.col("__raw"), "left")
    return met.withColumn(f"{column}_display", F.coalesce("__display", column)).drop("__raw", "__display")


BARRIER_DOCUMENT = [
    "incident_id", "control_id", "barrier_role_match_text", "barrier_family", "barrier_type", "side", "line_of_defense", "barrier_status", "barrier_failed",
    "barrier_failed_human", "human_contribution_value", *PIFS, "supporting_text", "confidence", "incident_summary",
]
INCIDENT_DOCUMENT = ["incident_id", "incident_embed_text", "top_event", "incident_type", "operating_phase", "materials", "region", "operator", "summary", "recommendations", "pif_tags_json"]


def _or(column: str, columns: list[str], default) -> Column:
    """The column, or its default where it is null or the table lacks it."""
    return F.coalesce(F.col(column), F.lit(default)) if column in columns else F.lit(default)


def barrier_documents(flat: DataFrame, incidents: DataFrame, family: Column) -> DataFrame:
    """One document a barrier, 26 columns: composed text, family, what is known of the control, and its incident's factors and summary.

    supporting_text is a list and comes out as JSON text. Unknown fields have
    the defaults of the schema.
    """
    have, about = flat.columns, incidents.columns
    quotes = F.coalesce("supporting_text", F.array().cast("array<string>")) if "supporting_text" in have else F.array().cast("array<string>")
    rows = flat.select(
        "incident_id",
        _or("control_id", have, "").alias("control_id"),
        text.compose_barrier_text(_or("name", have, ""), _or("barrier_role", have, ""), _or("lod_basis", have, "")).alias("barrier_role_match_text"),
        family.alias("barrier_family"),
        *[_or(c, have, "unknown").alias(c) for c in ("barrier_type", "side", "line_of_defense", "barrier_status")],
        *[_or(c, have, False).alias(c) for c in ("barrier_failed", "barrier_failed_human")],
        _or("human_contribution_value", have, "").alias("human_contribution_value"),
        F.to_json(quotes).alias("supporting_text"),
        _or("confidence", have, "low").alias("confidence"),
    )
    known = incidents.select("incident_id", *[_or(p, about, False).alias(p) for p in PIFS], _or("summary", about, "").alias("incident_summary"))
    return rows.join(known, "incident_id", "left").na.fill(False, PIFS).na.fill("", ["incident_summary"]).select(*BARRIER_DOCUMENT)


def incident_documents(incidents: DataFrame, value=factor_value) -> DataFrame:
    """One document an incident, 11 columns: composed text, its fields, lists as JSON text, and its negative factors as JSON or null."""
    have, none = incidents.columns, F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none) if c in have else none
    named = {c: _or(c, have, "unknown") for c in ("top_event", "incident_type", "operating_phase", "region", "operator")}
    summary, notes = _or("summary", have, ""), factor_notes(value)
    whole = text.compose_incident_text(named["top_event"], named["incident_type"], named["operating_phase"], listed("materials"), summary, listed("recommendations"), notes)
    columns = {
        "incident_embed_text": whole, **named, "materials": F.to_json(listed("materials")), "summary": summary,
        "recommendations": F.to_json(listed("recommendations")), "pif_tags_json": F.to_json(pif_tags(value)),
    }
    return incidents.select("incident_id", *[c.alias(n) for n, c in columns.items()]).select(*INCIDENT_DOCUMENT)


def json_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns as JSON text for a CSV sink."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def json_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """JSON text as lists again; what cannot be read is an empty list."""
    return df.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in columns})


def mentioned(category: str) -> Column:
    """The factors of a category that are set, as a map from name to true."""
    pairs = [x for f in FACTORS[category] for x in (F.lit(f), F.coalesce(F.col(f"pif_{f}"), F.lit(False)))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v)

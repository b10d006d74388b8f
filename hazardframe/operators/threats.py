"""Threats and barriers of an incident, in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_event_name(top_event: Column, description: Column, incident_type: Column) -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled(top_event), filled(description), filled(incident_type), F.lit("Loss of Containment"))


def threat_barrier_pairs(barriers: DataFrame, incidents: DataFrame) -> DataFrame:
    """(incident_id, control_seq, threat_id, threat_name, mapping_method), decided barrier by barrier.

    incidents: incident_id, threats (array of threat_id, threat_name, in order),
    top_event, description, incident_type, and error, null for a document that
    was read. explicit: the linked ids that the incident has, as often as they
    are linked; side_inferred: all threats of the incident, where none of them
    is; top_event_only: one made-up threat for an incident without any;
    json_error and json_missing: one where the document is bad or absent.
    """
    known = incidents.select("incident_id", "threats", top_event_name(F.col("top_event"), F.col("description"), F.col("incident_type")).alias("top"), "error", F.lit(True).alias("there"))
    met = barriers.select("incident_id", "control_seq", "linked_threat_ids").join(known, "incident_id", "left")
    threats = F.coalesce("threats", F.array().cast("array<struct<threat_id:string,threat_name:string>>"))
    linked = F.flatten(F.transform(F.coalesce("linked_threat_ids", F.array().cast("array<string>")), lambda x: F.slice(F.filter(threats, lambda t: t["threat_id"] == x), -1, 1)))
    one = lambda key, name: F.array(F.struct(F.lit(key).alias("threat_id"), name.alias("threat_name")))
    tiers = [
        ("json_missing", F.col("there").isNull(), one("T-UNKNOWN", F.lit("Unknown (JSON not found)"))),
        ("json_error", F.col("error").isNotNull(), one("T-ERROR", F.concat(F.lit("Error loading JSON: "), F.col("error")))),
        ("explicit", F.size(linked) > 0, linked),
        ("side_inferred", F.size(threats) > 0, threats),
        ("top_event_only", F.lit(True), one("T-TOP", F.col("top"))),
    ]
    method, found = F, F
    for name, here, rows in tiers:
        method, found = method.when(here, F.lit(name)), found.when(here, F.transform(rows, lambda t: F.struct(t["threat_id"].alias("threat_id"), t["threat_name"].alias("threat_name"))))
    decided = met.select("incident_id", "control_seq", method.alias("mapping_method"), F.explode(found).alias("t"))
    return decided.select("incident_id", "control_seq", "t.threat_id", "t.threat_name", "mapping_method")


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("mapping_method").agg(F.count("*").alias("pairs"), F.count_distinct("incident_id").alias("incidents"))


def uncovered(barriers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Barriers without a pair: must be none."""
    return barriers.select("incident_id", "control_seq").join(pairs, ["incident_id", "control_seq"], "left_anti")


def line_lookup(base: DataFrame, order: str) -> DataFrame:
    """(incident_id, control_id, lod_industry_standard, lod_numeric): the last row of each control in `order`."""
    fields = F.struct("lod_industry_standard", "lod_numeric")
    return base.groupBy("incident_id", "control_id").agg(F.max_by(fields, order).alias("r")).select("incident_id", "control_id", "r.*")


def agency_lookup(incidents: DataFrame, flat: DataFrame, known: list[str], order: str) -> DataFrame:
    """(incident_id, source_agency) of every incident: that of its first flat row in `order`, UNKNOWN if it has none or one that is not `known`."""
    first = flat.groupBy("incident_id").agg(F.min_by("source_agency", order).alias("a"))
    met = incidents.select("incident_id").distinct().join(first, "incident_id", "left")
    return met.select("incident_id", F.when(F.col("a").isin(known), F.col("a")).otherwise("UNKNOWN").alias("source_agency"))

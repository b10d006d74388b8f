"""Barrier coverage, gaps and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import GAP_STATUSES, STATUSES


def norm_status(status: Column) -> Column:
    """Null is blank; else trimmed lower case."""
    return F.lower(F.trim(F.coalesce(status.cast("string"), F.lit(""))))


def coverage(controls: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Per incident: totals, a count for each status, evidence counts, and (active + degraded / 2) / total.

    One aggregation makes every count. With `universe`, a frame of incident_id,
    incidents without controls have zeros and others are left out.
    """
    status = norm_status(F.col("barrier_status"))
    counts = controls.groupBy("incident_id").agg(
        F.count("*").alias("controls_total"),
        *[F.count_if((status == s) & F.col("control_id").isNotNull()).alias(f"status_{s}") for s in [*STATUSES]],
        F.count_if((status == "") & F.col("control_id").isNotNull()).alias("status_blank"),
        F.count_if(F.col("supporting_text_count") > 0).alias("with_text"),
        F.count_if(F.lower("confidence") == "high").alias("high_confidence"),
    )
    if universe is not None:
        counts = universe.select("incident_id").join(counts, "incident_id", "left").na.fill(0, [c for c in counts.columns if c != "incident_id"])
    score = F.when(F.col("controls_total") > 0, (F.col("status_active") + F.lit(0.5) * F.col("status_degraded")) / F.col("controls_total")).otherwise(F.lit(0.0))
    return counts.withColumn("coverage_score", score)


def in_report_order(covered: DataFrame) -> DataFrame:
    return covered.orderBy("coverage_score", F.desc("controls_total"), "incident_id")


def gaps(controls: DataFrame) -> DataFrame:
    """Controls that are gaps by status or by lack of evidence, with columns that may be missing added as blanks."""
    wanted = ["incident_id", "control_id", "name", "side", "barrier_role", "barrier_type", "line_of_defense", "barrier_status", "supporting_text_count", "confidence"]
    for name in wanted:
        if name not in controls.columns:
            controls = controls.withColumn(name, F.lit(""))
    return controls.where(norm_status(F.col("barrier_status")).isin(GAP_STATUSES) | (F.coalesce(F.col("supporting_text_count").cast("int"), F.lit(0)) <= 0)).select(*wanted)


def in_gap_order(gap_rows: DataFrame) -> DataFrame:
    return gap_rows.orderBy(*[F.asc_nulls_last(c) for c in ("incident_id", "barrier_status", "barrier_type", "name")])


ROLLUPS = ["barrier_type", "barrier_role", "side", "line_of_defense", "name"]
# A rollup is named by its dimension, but for that of names.
ROLLUP_NAMES = {"name": "by_control_name"}


def gap_rollups(gap_rows: DataFrame, dimensions: list[str] = ROLLUPS) -> DataFrame:
    """Tidy counts (rollup, dimension, value, gap_count) of every dimension in one pass; null values are left out."""
    dims = [d for d in dimensions if d in gap_rows.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p")
    counted = gap_rows.select(pairs).select("p.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("gap_count"))
    label = F.concat(F.lit("by_"), F.col("dimension"))
    for dimension, name in ROLLUP_NAMES.items():
        label = F.when(F.col("dimension") == dimension, name).otherwise(label)
    return counted.select(label.alias("rollup"), "dimension", "value", "gap_count")


def in_rollup_order(rollups: DataFrame) -> DataFrame:
    """Rollups one after another, each by count."""
    return rollups.orderBy("rollup", F.desc("gap_count"), "value")

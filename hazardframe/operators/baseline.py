"""Status distribution, failure rates, co-failures, human contribution, fleet means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_distribution(controls: DataFrame) -> DataFrame:
    """(barrier_status, n, share): null statuses have no row but count in the whole; the window sees one row for each status."""
    counts = controls.groupBy("barrier_status").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))
    return shares.where(F.col("barrier_status").isNotNull())


def failure_rates(controls: DataFrame, dimension: str) -> DataFrame:
    """(value, failed, total, rate); null values are left out, a missing column gives nothing."""
    if dimension not in controls.columns:
        return controls.sparkSession.createDataFrame([], "value string, failed long, total long, rate double")
    counted = controls.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).cast("string").alias("value"))
    counted = counted.agg(F.count_if("barrier_failed").alias("failed"), F.count("*").alias("total"))
    return counted.withColumn("rate", F.round(F.col("failed") / F.col("total"), 4))


def cofailures(controls: DataFrame, column: str = "name") -> DataFrame:
    """Pairs of names that failed in one incident, a < b, with the number of row pairs.

    Rows are counted per incident and name first; the join then meets distinct
    names only and multiplies the counts.
    """
    failed = controls.where("barrier_failed").where(F.col(column).isNotNull()).groupBy("incident_id", column).agg(F.count("*").alias("n"))
    a = failed.select("incident_id", F.col(column).alias("a"), F.col("n").alias("na"))
    b = failed.select("incident_id", F.col(column).alias("b"), F.col("n").alias("nb"))
    return a.join(b, "incident_id").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))


def human_contribution(controls: DataFrame) -> DataFrame:
    """Counts and shares (four digits, 0 for no controls) of controls with a human contribution and of those that failed by it."""
    mentioned, failed = F.coalesce(F.col("human_contribution_value") != "", F.lit(False)), F.coalesce(F.col("barrier_failed_human"), F.lit(False))
    share = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c), F.count("*")), 4), F.lit(0.0))
    return controls.agg(
        F.count("*").alias("controls"),
        F.count_if(mentioned).alias("mentioned"),
        share(mentioned).alias("mentioned_share"),
        F.count_if(failed).alias("failed_human"),
        share(failed).alias("failed_human_share"),
        F.count_if(F.col("barrier_failed") & failed).alias("failed_and_human"),
        F.count_distinct("incident_id").alias("incidents"),
    )


FLEET_SIDES = ["prevention", "mitigation"]


def fleet_coverage(present: DataFrame, reference: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Per incident: prevention, mitigation and overall coverage of the reference barriers, each at most 1.

    present: incident_id, side, name, repeated names counted as often as they
    occur. reference: side, name. A side counts the incident's names of it that
    the reference has on it; overall counts all names that it has at all, over
    all of its barriers. Names compare without case. Incidents of `universe`
    without a match have zeros.
    """
    key = F.lower("name").alias("key")
    wanted = reference.select("side", key).groupBy("key").agg(*[F.count_if(F.col("side") == s).alias(f"__{s}") for s in FLEET_SIDES])
    totals = reference.agg(*[F.count_if(F.col("side") == s).alias(f"__n_{s}") for s in FLEET_SIDES], F.count("*").alias("__n"))
    met = present.select("incident_id", "side", key).join(wanted, "key")
    counts = met.groupBy("incident_id").agg(*[F.count_if((F.col("side") == s) & (F.col(f"__{s}") > 0)).alias(s) for s in FLEET_SIDES], F.count("*").alias("overall"))
    if universe is not None:
        counts = universe.select("incident_id").join(counts, "incident_id", "left").na.fill(0, [*FLEET_SIDES, "overall"])
    wide = counts.join(F.broadcast(totals), F.lit(True))  # one row
    share = lambda n, of: F.when(F.col(of) > 0, F.least(F.lit(1.0), F.col(n) / F.col(of))).otherwise(F.lit(0.0)).alias(n)
    return wide.select("incident_id", *[share(s, f"__n_{s}") for s in FLEET_SIDES], share("overall", "__n"))


def fleet_gaps(present: DataFrame, reference: DataFrame, incidents: DataFrame) -> DataFrame:
    """(incident_id, side, name): reference barriers whose name an incident has on neither side.

    A bowtie's barriers, some tens, are one row of a list; each incident keeps
    of it what its own names lack.
    """
    have = present.groupBy("incident_id").agg(F.collect_set(F.lower("name")).alias("have"))
    wanted = reference.agg(F.collect_list(F.struct("side", "name")).alias("wanted"))
    met = incidents.select("incident_id").join(have, "incident_id", "left").join(F.broadcast(wanted), F.lit(True))  # one row
    lacking = F.filter("wanted", lambda b: ~F.coalesce(F.array_contains("have", F.lower(b["name"])), F.lit(False)))
    return met.select("incident_id", F.explode(lacking).alias("b")).select("incident_id", "b.side", "b.name")


def fleet_means(scores: DataFrame) -> DataFrame:
    """Means over incidents, missing scores as 0; an empty input gives one row of zeros."""
    mean = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias(c)
    return scores.agg(F.count("*").alias("incidents"), *[mean(c) for c in (*FLEET_SIDES, "overall")])

"""Families that fail together: transactions, counts and one-to-one rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import DID_NOT_PERFORM


def failed_items(controls: DataFrame, item: str = "family") -> DataFrame:
    """Distinct (incident_id, item) of controls that did not perform."""
    return controls.where(F.col("barrier_status").isin(DID_NOT_PERFORM) & F.col(item).isNotNull()).select("incident_id", F.col(item).alias("item")).distinct()


def transactions(items: DataFrame) -> DataFrame:
    return items.groupBy("incident_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count("*").alias("n"))


def pair_counts(items: DataFrame) -> DataFrame:
    """(a, b, n) with a < b. An incident has few families, so the join stays linear in the items."""
    a, b = items.select("incident_id", F.col("item").alias("a")), items.select("incident_id", F.col("item").alias("b"))
    return a.join(b, "incident_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def association_rules(items: DataFrame, support: float = 0.05, confidence: float = 0.5) -> DataFrame:
    """Rules a -> b of both directions with at least that support and confidence and a lift above 1.

    The population is the incidents with a failed barrier. Each incident's
    items meet once in an array and give every ordered pair and, as a pair with
    itself, every item; one combined count over these holds all that rules need.
    """
    sets = transactions(items)
    pair = F.explode(F.flatten(F.transform("items", lambda x: F.transform("items", lambda y: F.struct(x.alias("antecedent"), y.alias("consequent")))))).alias("p")
    counts = sets.select(pair).groupBy("p.antecedent", "p.consequent").agg(F.count("*").alias("n_both"))
    alone = F.when(F.col("antecedent") == F.col("consequent"), F.col("n_both"))
    counts = counts.withColumn("na", F.max(alone).over(Window.partitionBy("antecedent"))).withColumn("nc", F.max(alone).over(Window.partitionBy("consequent")))
    total = items.agg(F.count_distinct("incident_id").alias("population"))
    rules = counts.where("antecedent != consequent").join(F.broadcast(total), F.lit(True)).select(  # one row
        "antecedent",
        "consequent",
        "n_both",
        (F.col("n_both") / F.col("population")).alias("support"),
        (F.col("n_both") / F.col("na")).alias("confidence"),
        (F.col("n_both") * F.col("population") / (F.col("na") * F.col("nc"))).alias("lift"),
    )
    return rules.where((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("lift") > 1))


def in_rule_order(rules: DataFrame) -> DataFrame:
    """By confidence, then lift, then names."""
    return rules.orderBy(F.desc("confidence"), F.desc("lift"), "antecedent", "consequent")

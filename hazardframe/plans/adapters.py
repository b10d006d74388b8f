"""Incident-shaped views over the star schema, as DataFrames and as SQL.

Orders stand for incidents and line items for barriers. All mappings are integer
arithmetic and literals, so both engines agree. Nothing is read that a query
does not use: the views are plain projections that Catalyst prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import PIFS
from .registry import table

PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37]
LINE_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    # nation and region have a row for each country and continent
    where = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    wide = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("o_orderkey")
    return wide.select(
        key.alias("incident_id"),
        F.col("o_custkey").alias("customer_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_occurred"),
        F.col("r_name").alias("region"),
        F.col("c_name").alias("operator"),
        F.col("o_orderstatus").alias("incident_type"),
        F.col("o_orderpriority").alias("top_event"),
        F.when(key % 7 == 0, F.concat(F.col("r_name"), F.lit(" agency"))).otherwise("").alias("agency"),
        F.when(key % 7 == 1, "BSEE report").when(key % 7 == 2, "Recommendation Status Change").otherwise("unknown").alias("doc_type"),
        F.when(key % 7 == 3, "https://www.tsb.gc.ca/x").when(key % 7 == 4, "null").otherwise("").alias("url"),
        F.when(key % 7 == 5, "data/PHMSA/csb/i.json").otherwise("data/other/i.json").alias("json_path"),
        *[(key % p == 0).alias(name) for name, p in zip(PIFS, PRIMES, strict=True)],
    )


INCIDENTS = f"""incidents AS (SELECT o_orderkey AS incident_id, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS date_occurred,
  r_name AS region, c_name AS operator, o_orderstatus AS incident_type, o_orderpriority AS top_event,
  CASE WHEN o_orderkey % 7 = 0 THEN r_name || ' agency' ELSE '' END AS agency,
  CASE o_orderkey % 7 WHEN 1 THEN 'BSEE report' WHEN 2 THEN 'Recommendation Status Change' ELSE 'unknown' END AS doc_type,
  CASE o_orderkey % 7 WHEN 3 THEN 'https://www.tsb.gc.ca/x' WHEN 4 THEN 'null' ELSE '' END AS url,
  CASE WHEN o_orderkey % 7 = 5 THEN 'data/PHMSA/csb/i.json' ELSE 'data/other/i.json' END AS json_path,
  {", ".join(f"(o_orderkey % {p} = 0) AS {n}" for n, p in zip(PIFS, PRIMES, strict=True))}
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


def controls(spark: SparkSession, sf: str, named: bool = True) -> DataFrame:
    """Barriers; without `named` they lack name and barrier_role, and the join that brings them."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_KEYS)).cast("long")
    wide = line.withColumn("control_seq", seq)
    if named:
        wide = wide.join(part.select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    flags = F.concat("l_returnflag", "l_linestatus")
    status = F.when(F.col("l_suppkey") % 17 == 0, F.lit(None).cast("string"))
    for pair, name in (("NO", "active"), ("NF", "degraded"), ("RF", "failed"), ("RO", "bypassed"), ("AO", "not_installed"), ("AF", "unknown")):
        status = status.when(flags == pair, name)
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    lod = (F.col("l_linenumber") - 1) % 5
    threat = lambda c: F.concat(F.lit("T-00"), (F.col(c) % 5).cast("string"))
    return wide.select(
        F.col("l_orderkey").alias("incident_id"),
        "control_seq",
        F.concat(F.lit("C-"), F.lpad(F.col("control_seq").cast("string"), 3, "0")).alias("control_id"),
        *([F.col("p_name").alias("name"), F.col("p_type").alias("barrier_role")] if named else []),
        F.when(F.col("l_linenumber") % 2 == 1, "prevention").otherwise("mitigation").alias("side"),
        pick(F.col("l_partkey") % 4, ["engineering", "administrative", "ppe", "unknown"]).alias("barrier_type"),
        pick(lod, ["1st", "2nd", "3rd", "recovery", "unknown"]).alias("line_of_defense"),
        F.when(lod == 4, 99).otherwise(lod + 1).cast("int").alias("lod_numeric"),
        status.alias("barrier_status"),
        (F.col("l_quantity") > 25).alias("barrier_failed"),
        (F.col("l_suppkey") % 3 == 0).alias("barrier_failed_human"),
        F.when(F.col("l_partkey") % 3 == 0, "").when(F.col("l_partkey") % 3 == 1, F.lit(None).cast("string")).otherwise("slip").alias("human_contribution_value"),
        (F.round(F.col("l_tax") * 100).cast("int") % 4).alias("supporting_text_count"),
        pick(F.col("l_partkey") % 3, ["high", "medium", "low"]).alias("confidence"),
        F.array(threat("l_partkey"), threat("l_suppkey")).alias("linked_threat_ids"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


CONTROLS = f"""controls AS (SELECT l_orderkey AS incident_id, control_seq, concat('C-', lpad(CAST(control_seq AS VARCHAR), 3, '0')) AS control_id,
  p_name AS name, p_type AS barrier_role, CASE WHEN l_linenumber % 2 = 1 THEN 'prevention' ELSE 'mitigation' END AS side,
  CASE l_partkey % 4 WHEN 0 THEN 'engineering' WHEN 1 THEN 'administrative' WHEN 2 THEN 'ppe' ELSE 'unknown' END AS barrier_type,
  CASE (l_linenumber - 1) % 5 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' WHEN 2 THEN '3rd' WHEN 3 THEN 'recovery' ELSE 'unknown' END AS line_of_defense,
  CAST(CASE WHEN (l_linenumber - 1) % 5 = 4 THEN 99 ELSE (l_linenumber - 1) % 5 + 1 END AS INTEGER) AS lod_numeric,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'active' WHEN l_returnflag = 'N' THEN 'degraded'
    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'bypassed' WHEN l_linestatus = 'O' THEN 'not_installed' ELSE 'unknown' END AS barrier_status,
  l_quantity > 25 AS barrier_failed, l_suppkey % 3 = 0 AS barrier_failed_human,
  CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'slip' END AS human_contribution_value,
  CAST(round(l_tax * 100) AS INTEGER) % 4 AS supporting_text_count, CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  ['T-00' || CAST(l_partkey % 5 AS VARCHAR), 'T-00' || CAST(l_suppkey % 5 AS VARCHAR)] AS linked_threat_ids, CAST(l_quantity AS INTEGER) AS quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_KEYS)}) AS control_seq FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey)"""


def threats(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three threats an incident, T-001 on; some have none."""
    orders = table(spark, sf, "orders")
    ids = F.transform(F.sequence(F.lit(1), (F.col("o_custkey") % 4).cast("int")), lambda k: F.concat(F.lit("T-00"), k.cast("string")))
    kept = orders.where(F.col("o_custkey") % 4 > 0)
    return kept.select(F.col("o_orderkey").alias("incident_id"), F.explode(ids).alias("threat_id")).withColumn("threat_name", F.concat(F.lit("threat "), F.col("threat_id")))


THREATS = """threats AS (SELECT o_orderkey AS incident_id, 'T-00' || CAST(k AS VARCHAR) AS threat_id, 'threat T-00' || CAST(k AS VARCHAR) AS threat_name
  FROM orders, (VALUES (1), (2), (3)) AS v(k) WHERE k <= o_custkey % 4)"""

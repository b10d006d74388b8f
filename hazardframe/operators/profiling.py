"""Profiles and contracts of control and incident relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import DID_NOT_PERFORM, MODEL_PIFS


def known(controls: DataFrame) -> DataFrame:
    """All rows whose status is not unknown; null counts as known."""
    return controls.where(~F.col("barrier_status").eqNullSafe("unknown"))


def labels(controls: DataFrame) -> DataFrame:
    """label_barrier_failed from the status alone; label_barrier_failed_human also needs the human flag."""
    failed = F.coalesce(F.col("barrier_status").isin(DID_NOT_PERFORM), F.lit(False))
    human = F.coalesce(F.lower(F.trim(F.col("barrier_failed_human").cast("string"))) == "true", F.lit(False))
    return controls.withColumns({"label_barrier_failed": failed.cast("int"), "label_barrier_failed_human": (failed & human).cast("int")})


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, distinct) in one pass, turned to rows at the end."""
    one = df.agg(*[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])).alias("r")
    return one.select(rows).select("r.*")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value): sorted by the caller; shuffles distinct values only."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where("value is not null").distinct()


def join_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side, matched, and orphans both ways, from one tagged aggregate."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(
        F.sum("l").alias("left_keys"),
        F.sum("r").alias("right_keys"),
        F.count_if(F.expr("l = 1 and r = 1")).alias("matched"),
        F.count_if(F.expr("l = 1 and r = 0")).alias("left_orphans"),
        F.count_if(F.expr("l = 0 and r = 1")).alias("right_orphans"),
    )


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def label_stats(labelled: DataFrame, names: tuple[str, ...] = ("label_barrier_failed", "label_barrier_failed_human")) -> DataFrame:
    """(label, n, positives, rate, warning): rates below 0.03 or above 0.25 are flagged."""
    one = labelled.agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in names])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("positives")) for c in names])).alias("r")).select("r.label", "n", "r.positives")
    rate = F.col("positives") / F.col("n")
    return rows.withColumn("rate", rate).withColumn("warning", F.when(rate < 0.03, "low").when(rate > 0.25, "high").otherwise("none"))


def with_factors(controls: DataFrame, incidents: DataFrame, factors: list[str] = MODEL_PIFS) -> DataFrame:
    """Controls with the factors of their incident as 0 or 1; a factor or incident that is missing is 0."""
    have = [c for c in factors if c in incidents.columns]
    joined = controls.join(incidents.select("incident_id", *have), "incident_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)).cast("int") if c in have else F.lit(0) for c in factors})


def factor_profile(labelled: DataFrame, factors: list[str], label: str) -> DataFrame:
    """(factor, share, r, p): how often a factor is set, its correlation with the label (0 if undefined), and the two-sided p of that."""
    stats = labelled.agg(F.count("*").alias("n"), F.sum(label).alias("sy"), *[x for c in factors for x in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(label)).alias(f"p_{c}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"s_{c}").alias("sx"), F.col(f"p_{c}").alias("sxy")) for c in factors])).alias("f")
    flat = stats.select("n", "sy", rows).select("n", "sy", "f.*")
    spread = (F.col("n") * F.col("sx") - F.col("sx") * F.col("sx")).cast("double") * (F.col("n") * F.col("sy") - F.col("sy") * F.col("sy")).cast("double")
    r = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).otherwise(F.lit(0.0))
    rows = flat.select("factor", (F.col("sx") / F.col("n")).alias("share"), r.alias("r"), "n")
    return rows.select("factor", "share", "r", correlation_p_value(F.col("r"), F.col("n")).alias("p"))


# The Lanczos series for the logarithm of the gamma function, with g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 0.5 and more."""
    z = x - 1
    series = sum((F.lit(c) / (z + k) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta where x is at most (a + 1) / (a + b + 2): its continued fraction, step by step until it settles."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    most = F.least(F.lit(200_000), F.lit(60) + F.ceil(12 * F.sqrt(F.greatest(a, b)))).cast("int")
    start = F.struct(F.lit(1.0).alias("f"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(False).alias("done"))
    steady = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(k == 0, F.lit(1.0)).when(k % 2 == 0, even).otherwise(odd)
        d, c = 1 / steady(1 + term * s["d"]), steady(1 + term / s["c"])
        return F.when(s["done"], s).otherwise(F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"), (F.abs(1 - c * d) < 1e-15).alias("done")))

    return front * (F.aggregate(F.sequence(F.lit(0), most), start, step, lambda s: s["f"]) - 1)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of columns, for a and b of 0.5 and more."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    direct = x <= (a + 1) / (a + b + 2)
    inner = F.when(direct, x).otherwise(1 - x)
    found = _fraction(F.when(direct, a).otherwise(b), F.when(direct, b).otherwise(a), inner)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(direct, found).otherwise(1 - found)


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by the t distribution with n - 2 degrees of freedom; 1 where there is none."""
    r = r.cast("double")
    found = incomplete_beta((n - 2) / 2, F.lit(0.5), 1 - r * r)
    return F.when((n < 3) | r.isNull() | F.isnan(r), F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(found)


def drop_audit(rows: DataFrame) -> DataFrame:
    """Rows of undefined line of defence: by name, by number, by both, by either, and what is left."""
    other, high = F.coalesce(F.col("lod_name") == "Other", F.lit(False)), F.coalesce(F.col("lod_numeric") == 99, F.lit(False))
    return rows.agg(F.count("*").alias("rows_in"), F.count_if(other).alias("other"), F.count_if(high).alias("code_99"), F.count_if(other & high).alias("both"), F.count_if(other | high).alias("dropped"), F.count_if(~(other | high)).alias("rows_out"))


def contract(df: DataFrame, required: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the required columns; an unexpected or a missing one is an error, *_mentioned columns are dropped."""
    have = {c for c in df.columns if not c.endswith("_mentioned")}
    if extra := have - set(required) - set(optional):
        raise ValueError(f"unexpected columns: {sorted(extra)}")
    if missing := set(required) - have:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.select(*required)


def ordinal_encoding(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes by sorted category, null as 'unknown'."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).distinct()
    return values.withColumn("code", F.dense_rank().over(Window.orderBy("value")) - 1)


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """`column` replaced by its code; values without one are -1."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    return df.withColumn("__v", value).join(codes.select(F.col("value").alias("__v"), "code"), "__v", "left").withColumn(column, F.coalesce("code", F.lit(-1))).drop("__v", "code")


#: Categories of one column that `encode_all` takes.
MOST_CATEGORIES = 10_000


def encode_all(df: DataFrame, columns: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Every column replaced by its code, as `encode` does, from one pass over `reference` (the rows themselves if not given).

    The sorted categories of all columns are one row of short lists that goes
    with every task. More than `MOST_CATEGORIES` of one column stop the query:
    such a column is no category, and `encode` joins its codes instead.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value(c).alias("v")) for c in columns])).alias("p")
    distinct = (reference if reference is not None else df).select(each).groupBy("p.c", "p.v").agg(F.lit(1).alias("one"))
    lists = distinct.groupBy("c").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("v")).alias("all"))
    lists = lists.withColumn("all", F.when(F.col("n") > MOST_CATEGORIES, F.raise_error(F.lit("too many categories to encode as one list"))).otherwise(F.col("all")))
    codes = lists.agg(*[F.max(F.when(F.col("c") == c, F.col("all"))).alias(f"__{c}") for c in columns])
    wide = df.join(F.broadcast(codes), F.lit(True), "left")  # one row
    return wide.withColumns({c: F.coalesce(F.array_position(F.col(f"__{c}"), value(c)), F.lit(0)) - 1 for c in columns}).drop(*[f"__{c}" for c in columns])


def class_weight(labelled: DataFrame, label: str) -> DataFrame:
    """One row: negatives over positives."""
    y: Column = F.col(label)
    return labelled.agg((F.count_if(y == 0) / F.nullif(F.count_if(y == 1), F.lit(0))).alias("weight"))


def base_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, distinct_values, nulls, low, high, mean) of numeric columns, one pass."""
    aggs = [x for c in columns for x in (F.count_distinct(c).alias(f"d_{c}"), F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.min(c).cast("double").alias(f"l_{c}"), F.max(c).cast("double").alias(f"h_{c}"), F.avg(c).alias(f"m_{c}"))]
    fields = lambda c: F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}_{c}").alias(n) for k, n in (("d", "distinct_values"), ("n", "nulls"), ("l", "low"), ("h", "high"), ("m", "mean"))])
    return df.agg(*aggs).select(F.explode(F.array(*map(fields, columns))).alias("r")).select("r.*")


def reject(df: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is allowed, and the others with a reason; nothing is dropped silently."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("reason", F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def strict(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The rows as they are; one whose value is not allowed stops the query and names it."""
    message = F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return df.withColumn(column, F.when(F.coalesce(F.col(column).isin(allowed), F.lit(False)), F.col(column)).otherwise(F.raise_error(message)))


def left_join_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that neither adds rows nor leaves any without a match: else the query stops."""
    counted = right.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    joined = left.join(counted, key, "left")
    n = F.when(F.col("__n").isNull(), F.raise_error(F.lit(f"{key} without a match"))).when(F.col("__n") > 1, F.raise_error(F.lit(f"{key} matches twice"))).otherwise(F.col("__n"))
    return joined.withColumn("__n", n.cast("long")).where("__n = 1").drop("__n")


def in_scope(df: DataFrame, scope: DataFrame, key: str = "incident_id") -> DataFrame:
    return df.join(scope.select(key).distinct(), key, "left_semi")

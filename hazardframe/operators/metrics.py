"""Classifier metrics, folds and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(scored: DataFrame, keys: list[str] = (), threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1 and the Matthews coefficient; undefined ratios are 0. scored: y, score."""
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    n = scored.groupBy(*keys).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return n.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": F.when(spread > 0, (tp * tn - fp * fn) / F.sqrt(spread)).otherwise(F.lit(0.0)),
        }
    )


def _blocked(counts: DataFrame, keys: list[str], value: str, blocks: int) -> DataFrame:
    """`counts` with `block`: ranges of the value, cut at approximate quantiles of its distinct values, so that each has about as many of them, however far some lie off."""
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [k / blocks for k in range(1, blocks)], 10 * blocks).alias("__cuts"))
    if keys:  # one row a key
        met = counts.join(cuts, keys)
    else:
        met = counts.join(F.broadcast(cuts), F.lit(True))  # one row
    low, high = F.lit(0), F.size("__cuts")
    # how many cuts are below the value: a search by halves, as many steps as the number of cuts has bits
    steps = F.sequence(F.lit(1), F.lit(max(1, blocks.bit_length())))
    start = F.struct(low.cast("int").alias("a"), high.cast("int").alias("b"))

    def halve(s, _):
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        below = F.get(F.col("__cuts"), middle) < F.col(value)
        done = s["a"] >= s["b"]
        return F.struct(F.when(done | ~below, s["a"]).otherwise(middle + 1).alias("a"), F.when(done | below, s["b"]).otherwise(middle).alias("b"))

    return met.withColumn("block", F.aggregate(steps, start, halve, lambda s: s["a"])).drop("__cuts")


def roc_auc(scored: DataFrame, keys: list[str] = (), blocks: int = 256) -> DataFrame:
    """Area under the curve by ranks, ties at their mean. scored: y, score.

    Counts of each score come first; running sums go within blocks of scores
    and over the blocks, so no window holds the distinct scores of all rows.
    """
    keys = list(keys)
    counts = _blocked(scored.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos")), keys, "score", blocks)
    inside = Window.partitionBy(*keys, "block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys or [F.lit(1)]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy(*keys, "block").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(across), F.lit(0))).drop("m")
    below = F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = counts.withColumn("below", below).join(base, [*keys, "block"])
    rank = F.col("base") + F.col("below") + (F.col("n") + 1) / 2
    sums = placed.groupBy(*keys).agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    auc = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")))
    return sums.select(*keys, F.round(auc, 9).alias("auc"))


def fold_quotas(histogram: dict[int, int], folds: int) -> dict[int, list[int]]:
    """{size: groups of that size for each fold}: the largest first, each to the fold that is lightest then, the first of equals.

    All groups of one size are dealt at once: the c smallest of the loads that the
    folds would have before their next such group say where they go.
    """
    loads, out = [0] * folds, {}
    for size in sorted(histogram, reverse=True):
        c = histogram[size]
        below = lambda level, size=size: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731  groups whose turn comes before `level`
        low, high = min(loads), max(loads) + size * (c // folds + 2)
        while high - low > 1:  # the highest level that c groups fill
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= c else (low, middle)
        quota = below(low)
        for f in range(folds):
            if sum(quota) < c and loads[f] + quota[f] * size == low:
                quota[f] += 1
        out[size] = quota
        loads = [load + n * size for load, n in zip(loads, quota, strict=True)]
    return out


#: Sizes of groups, with their quotas, that are broadcast.
QUOTAS_AT_MOST = 200_000


def fold_assignment(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(grp, n, fold): groups whole, the largest dealt first, each to the lightest fold; keys of any type that has an order.

    Only how many groups there are of each size meets on the driver, no more than
    the square root of twice the rows. Groups of one size, of which there may be
    very many, are numbered over range partitions in the order of their keys: a
    partition counts its own, and the counts of those before it are added.
    """
    spark = rows.sparkSession
    path = work_folder(spark, "folds")
    sizes = rows.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    sizes.repartitionByRange("n", "grp").sortWithinPartitions("n", "grp").withColumn("i", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(sizes.select("*", F.lit(0).cast("long").alias("i")).schema).parquet(path).withColumn("part", F.shiftright("i", 33))
    parts = placed.groupBy("part", "n").agg(F.count("*").alias("m"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = {r["n"]: r["m"] for r in parts.groupBy("n").agg(F.sum("m").alias("m")).collect()}
    upto = [(n, [sum(q[: k + 1]) for k in range(folds - 1)]) for n, q in fold_quotas(histogram, folds).items()]
    known = parts.select("part", "n", (before - F.col("first")).alias("shift")).join(spark.createDataFrame(upto, "n long, upto array<long>"), "n")
    known = F.broadcast(known) if len(upto) <= QUOTAS_AT_MOST else known
    place = F.col("i") + F.col("shift")
    return placed.join(known, ["part", "n"]).select("grp", "n", F.size(F.filter("upto", lambda q: q <= place)).alias("fold"))


def fold_summary(per_fold: DataFrame, columns: list[str]) -> DataFrame:
    """Means and population deviations over folds."""
    return per_fold.agg(*[x for c in columns for x in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))])


def auc_gate(per_fold: DataFrame, mean: float = 0.70, least: float = 0.60) -> DataFrame:
    return per_fold.agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.min("auc").alias("least_auc"), ((F.avg("auc") >= mean) & (F.min("auc") >= least)).alias("passed"))


def branch(per_fold: DataFrame) -> DataFrame:
    """One row: mean_auc, least_auc and the branch: A for a mean of 0.70 and no fold under 0.60, B for 0.60 and 0.55, else C."""
    one = per_fold.agg(F.avg("auc").alias("mean_auc"), F.min("auc").alias("least_auc"))
    good = lambda mean, least: (F.col("mean_auc") >= mean) & (F.col("least_auc") >= least)
    return one.withColumn("branch", F.when(good(0.70, 0.60), "A").when(good(0.60, 0.55), "B").otherwise("C"))


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], blocks: int = 256) -> DataFrame:
    """One row: the percentile of each share, linear between neighbours as usual; null for no rows.

    Values are counted first, then summed within and over blocks of about as many
    distinct values each, so no task holds the distinct values of all rows; only the
    few blocks' sums meet, and of the values the two that each percentile lies between.
    The counts are written, as values may be costly to make: `rows` is read once.
    """
    spark = rows.sparkSession
    path = work_folder(spark, "percentiles")
    rows.select(F.col(column).cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n")).write.parquet(path)
    counts = spark.read.schema("x double, n long").parquet(path)
    total = counts.agg(F.sum("n")).head()[0] or 0
    placed = _blocked(counts, [], "x", blocks)
    sums = placed.groupBy("block").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = sorted({k for s in shares.values() for k in (int((total - 1) * s), min(int((total - 1) * s) + 1, total - 1))}) if total else []
    # only blocks that hold a wanted place go on
    hit = F.lit(False)
    for k in wanted:
        hit = hit | ((F.col("base") <= k) & (F.lit(k) < F.col("base") + F.col("m")))
    inside = placed.join(F.broadcast(sums.where(hit).select("block", "base")), "block")
    upto = F.sum("n").over(Window.partitionBy("block").orderBy("x")) + F.col("base")
    ranked = inside.withColumn("upto", upto)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    places = {name: (total - 1) * s for name, s in shares.items()} if total else {}
    out = [(at(int(p)) + (p - int(p)) * (at(min(int(p) + 1, total - 1)) - at(int(p)))).alias(n) for n, p in places.items()]
    return ranked.agg(*out) if total else counts.agg(*[F.max(F.lit(None).cast("double")).alias(n) for n in shares])


def thresholds(scored: DataFrame, score: str = "score") -> DataFrame:
    found = percentiles(scored, score, {"p60": 0.6, "p80": 0.8})
    return found.select(*[F.round(c, 9).alias(c) for c in ("p60", "p80")])


def per_class_metrics(scored: DataFrame, classes: list[str]) -> DataFrame:
    """(class, precision, recall, f1, support) of each class. scored: y and predicted, names of classes."""
    rows = scored.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col("y") == c).alias("is"), (F.col("predicted") == c).alias("said")) for c in classes])).alias("r")).select("r.*")
    n = rows.groupBy("class").agg(F.count_if(F.col("is") & F.col("said")).alias("tp"), F.count_if(~F.col("is") & F.col("said")).alias("fp"), F.count_if(F.col("is") & ~F.col("said")).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return n.select("class", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def inconsistent(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys for which a column that should be constant is not."""
    counts = rows.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.where(" or ".join(f"`{c}` > 1" for c in columns))


def decision(mean_a: float, std_a: float, mean_b: float, std_b: float) -> str:
    """The variant with the larger mean, then the smaller deviation, then the first."""
    return "a" if (mean_a, -std_a) >= (mean_b, -std_b) else "b"

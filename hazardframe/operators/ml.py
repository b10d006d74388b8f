"""Models over feature matrices: Spark's logistic regression, and second-order trees."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting, metrics, trees


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """weight: positives count as negatives over positives, so both classes weigh the same."""
    n, p = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).head()
    ratio = (n - p) / p if p else 1.0
    return rows.withColumn("weight", F.when(F.col(label) == 1, float(ratio)).otherwise(1.0))


def logistic(features: list[str], label: str) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)]
    return Pipeline(stages=stages)


def boosted(features: list[str], label: str, rounds: int = 400, categorical: tuple[str, ...] = ()) -> boosting.Learner:
    """Second-order trees of depth 4, step 0.05, four fifths of the rows and of the columns a tree, children of a hessian of 5 at least, seed 42."""
    return boosting.Learner(features, label, rounds, categorical=tuple(categorical))


def predictions(model: PipelineModel | boosting.BoostedTrees, rows: DataFrame, *keep) -> DataFrame:
    if isinstance(model, boosting.BoostedTrees):
        return model.scored(rows, *keep)
    scored = model.transform(rows)
    return scored.select(*keep, F.element_at(vector_to_array("probability"), 2).alias("score"))


def cross_validate(build, rows: DataFrame, features: list[str], label: str, group: str, folds: int = 5) -> DataFrame:
    """Metrics of each fold, groups whole: one model a fold."""
    dealt = rows.join(metrics.fold_assignment(rows, group, folds).select(F.col("grp").alias(group), "fold"), group)
    out = None
    for k in range(folds):
        model = build(features, label).fit(weighted(dealt.where(F.col("fold") != k), label))
        scored = predictions(model, weighted(dealt.where(F.col("fold") == k), label), F.lit(k).alias("fold"), F.col(label).alias("y"))
        out = scored if out is None else out.unionByName(scored)
    per_fold = metrics.binary_metrics(out, ["fold"])
    return per_fold.join(metrics.roc_auc(out, ["fold"]), "fold")


# The tiers that a model's metadata states.
TIERS = {"high": 0.66, "medium": 0.33}


def cascade_model(rows: DataFrame, categorical: list[str], numeric: list[str], label: str, rounds: int = 400) -> boosting.BoostedTrees:
    """Encoder (categories by sorted value, unseen ones -1), then boosted trees, fitted on the rows; positives weigh as much as negatives."""
    return boosted([*categorical, *numeric], label, rounds, tuple(categorical)).fit(weighted(rows, label))


def train_cascade(pairs: DataFrame, categorical: list[str], numeric: list[str], label: str, group: str = "incident_id", folds: int = 5, rounds: int = 400) -> tuple[boosting.BoostedTrees, dict]:
    """The model of all pairs, and its metadata: features, rows, share of positives, weight, and the folds' areas under the curve."""
    dealt = pairs.join(metrics.fold_assignment(pairs, group, folds).select(F.col("grp").alias(group), "fold"), group)
    aucs = []
    for k in range(folds):
        model = cascade_model(dealt.where(F.col("fold") != k), categorical, numeric, label, rounds)
        held = dealt.where(F.col("fold") == k).withColumn("weight", F.lit(1.0))
        aucs.append(metrics.roc_auc(predictions(model, held, F.col(label).alias("y"))).head()["auc"])
    n, positives = pairs.agg(F.count("*"), F.sum(label)).head()
    known = [a for a in aucs if a is not None]
    mean = sum(known) / len(known) if known else None
    spread = (sum((a - mean) ** 2 for a in known) / len(known)) ** 0.5 if known else None
    metadata = {
        "target": label, "categorical_features": categorical, "numerical_features": numeric, "all_features": [*categorical, *numeric], "risk_tier_thresholds": TIERS, "training_rows": n, "positive_rate": positives / n if n else None,
        "scale_pos_weight": (n - positives) / positives if positives else None, "rounds": rounds, "cv_scores": {"per_fold": aucs, "mean": mean, "std": spread},
    }
    return cascade_model(pairs, categorical, numeric, label, rounds), metadata


class Predictor:
    """A saved cascade model: scores pairs, ranks targets, explains a pair."""

    def __init__(self, model: PipelineModel | boosting.BoostedTrees, metadata: dict):
        self.model, self.metadata = model, metadata
        self.features = metadata["all_features"]

    @classmethod
    def load(cls, spark, path: str) -> Predictor:
        from ..sources import sinks

        return cls(*sinks.load_model(spark, path))

    def _rows(self, pairs: DataFrame) -> DataFrame:
        if missing := [c for c in self.features if c not in pairs.columns]:
            raise ValueError(f"the model needs {missing}")
        return pairs.withColumn("weight", F.lit(1.0))

    def predict(self, pairs: DataFrame, *keys: str) -> DataFrame:
        """(keys, p), largest first where collected in order."""
        return predictions(self.model, self._rows(pairs), *keys).withColumnRenamed("score", "p")

    def explain(self, pairs: DataFrame, *keys: str) -> DataFrame:
        """(keys, score, feature, value): each feature's part of the log-odds."""
        return trees.explained(self.model, self._rows(pairs), self.features, list(keys))


def tier(p: Column) -> Column:
    return F.when(p >= TIERS["high"], "HIGH").when(p >= TIERS["medium"], "MEDIUM").otherwise("LOW")


def score_targets(candidates: DataFrame, models: dict[str, boosting.BoostedTrees], keys: list[str], digits: int = 9) -> DataFrame:
    """`candidates` with probability_<name>, risk_tier_<name> and risk_rank_<name> of each model; equal probabilities share the better rank.

    All models score in one pass, within the plan, and all ranks come from one
    exchange by `keys`, what the candidates of a question share.
    """
    for name, model in models.items():
        if missing := [c for c in model.features if c not in candidates.columns]:
            raise ValueError(f"{name} needs {missing}")
    inputs = candidates.select("*", *[F.array(*m.inputs()).alias(f"__{k}") for k, m in enumerate(models.values())])
    p = {name: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-m.margin(f"__{k}"))), digits) for k, (name, m) in enumerate(models.items())}
    scored = inputs.withColumns({f"probability_{n}": c for n, c in p.items()}).drop(*[f"__{k}" for k in range(len(models))])
    rank = lambda n: F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(f"probability_{n}")))
    return scored.withColumns({f"risk_tier_{n}": tier(F.col(f"probability_{n}")) for n in models}).withColumns({f"risk_rank_{n}": rank(n) for n in models})


def retrain(rows: DataFrame, features: list[str], labels: list[str], group: str, drop: tuple[str, ...] = ("source_agency", "label_multiclass"), folds: int = 5, rounds: int = 300) -> dict[str, dict]:
    """For each label both learners: metrics over folds, and the model of all rows with the rows that explanations start from."""
    kept = rows.drop(*drop)
    if missing := [c for c in features if c not in kept.columns]:
        raise ValueError(f"missing features: {missing}")
    out: dict[str, dict] = {}
    for label in labels:
        learners = {"logreg": logistic, "boosted": lambda f, y: boosted(f, y, rounds)}
        out[label] = {name: {"folds": cross_validate(build, kept, features, label, group, folds), "model": build(features, label).fit(weighted(kept, label))} for name, build in learners.items()}
        out[label]["background"] = background(kept.select(*features))
    return out


def linear_contributions(rows: DataFrame, features: list[str], weights: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, feature, value): exact additive contributions of a linear model, weight x (value - mean)."""
    means = rows.agg(*[F.avg(f).alias(f"__{f}") for f in features])
    wide = rows.join(F.broadcast(means), F.lit(True))  # one row
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(weights[f]) * (F.col(f) - F.col(f"__{f}"))).alias("value")) for f in features])).alias("c")
    return wide.select(*keys, parts).select(*keys, "c.*")


def background(rows: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """A seeded sample of n rows, by the least hashes."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns)).limit(n)


def ablation(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """(metric, full, reduced, impact): whether leaving factors out moved the mean by more than 0.01."""
    both = full.agg(*[F.avg(c).alias(f"f_{c}") for c in ("f1", "mcc")]).join(reduced.agg(*[F.avg(c).alias(f"r_{c}") for c in ("f1", "mcc")]), F.lit(True))
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"f_{c}").alias("full"), F.col(f"r_{c}").alias("reduced")) for c in ("f1", "mcc")])).alias("m")).select("m.*")
    gain = F.col("full") - F.col("reduced")
    return rows.withColumn("impact", F.when(gain > 0.01, "improved").when(gain < -0.01, "degraded").otherwise("neutral"))

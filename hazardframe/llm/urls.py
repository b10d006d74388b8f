"""URL filter: rules by host and path, and gradient-boosted trees on lexical features.

The longest rule that fits decides. Its verdicts are the labels from which the
trees learn; they judge the urls that no rule fits. Features are the length,
depth, digit, letter and vowel shares, character entropy, the mean letter of the path's first step, counts of parameters, labels
and marks, and statistics of the host's suffix: how common it is, and how deep
and long its paths are, over all distinct urls. No feature knows a label, and
suffixes that a rule names, or that end one, give no statistics: with them the
trees would only relearn the rules and judge every other url by its top-level
domain. `agreement` measures how well the rules' verdicts are met on hosts that
the trees have not seen.

Suffixes are counted, and trees grown, over every distinct url by Spark
(`operators/boosting.py`): a level of a tree is one sum of gradients by node,
feature and bin, of whole numbers, so that the sums do not depend on partitions
and repeated urls count once. Bins are cut at quantiles that Spark approximates
to 1 in 100,000 of the rows. Every url is judged. With no labelled url at all,
everything else is allowed. Only `agreement`, a report, draws a sample.

Defined results: a null url or one without `://` has empty host and path, meets
no rule and is judged by its text as it is (null: empty). Repeated urls get the
same verdict. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.boosting import BoostedTrees, Learner
from .common import Scratch, hot_join, quoted, without

#: Labelled urls that `agreement` measures on.
SAMPLE = 20_000
SEED = 11
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
REPORT = ["host", "path", "rule", "verdict"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of a short list, or null: its host or a subdomain of it, and a path that begins with the rule's."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


def features(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    out = np.zeros((len(urls), 19))
    for row, (u, h, p) in zip(out, zip(urls, hosts, paths, strict=True), strict=True):
        data = np.frombuffer(u.encode(), np.uint8)
        n = max(1, len(data))
        counts = np.bincount(data, minlength=256)
        digits, letters = counts[48:58].sum(), counts[65:91].sum() + counts[97:123].sum()
        query = u.partition("?")[2].partition("#")[0]
        steps = [x for x in p.split("/") if x]
        row[:] = (
            len(data), len(h), len(p), p.count("/"), digits / n, letters / n, _entropy(data), query.count("&") + bool(query), len(query),
            h.count("."), counts[45] + counts[95], "#" in u, u.startswith("https"), max(map(len, p.split("/"))),
            _entropy(np.frombuffer(h.encode(), np.uint8)), _entropy(np.frombuffer(p.encode(), np.uint8)), _vowels(steps[0]) if steps else 0, _vowels(p),
            np.frombuffer(steps[0].encode(), np.uint8).mean() if steps else 0,
        )
    return out


def _entropy(data: np.ndarray) -> float:
    counts = np.bincount(data) if len(data) else np.zeros(0)
    share = counts[counts > 0] / max(1, len(data))
    return float(-(share * np.log2(share)).sum())


def _vowels(text: str) -> float:
    return sum(map(text.lower().count, "aeiou")) / max(1, len(text))


class Trees:
    """Boosted regression trees of logistic loss over quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(x), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            leaf, tree = np.zeros(len(x), int), [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            for at in range(len(tree)):
                mine = np.flatnonzero(leaf == at)
                if not len(mine):
                    continue
                g, w = gradient[mine], weight[mine]
                value = self.rate * g.sum() / (w.sum() + 1.0)
                best = self._split(binned[mine], g, w, edges) if at < 2**self.depth - 1 and len(mine) >= 2 * self.least else None
                tree[at] = (-1, 0.0, value) if best is None else (best[0], float(edges[best[0]][best[1]]), value)
                if best is not None:
                    leaf[mine] = 2 * at + 1 + (binned[mine, best[0]] > best[1])
            self.trees.append(tree)
            score += self._leaves(tree, x)
        return self

    def _split(self, binned, g, w, edges):
        best, top = None, 1e-6
        whole_g, whole_w = g.sum(), w.sum() + 1.0
        for f, e in enumerate(edges):
            if not len(e):
                continue
            n, sg, sw = (np.cumsum(np.bincount(binned[:, f], v, len(e) + 1))[:-1] for v in (None, g, w))
            gain = sg**2 / (sw + 1.0) + (whole_g - sg) ** 2 / (whole_w - sw) - whole_g**2 / whole_w
            gain[(n < self.least) | (len(g) - n < self.least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > top:
                best, top = (f, k), gain[k]
        return best

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]), at)
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self._leaves(tree, x)
        return 1 / (1 + np.exp(-score))


def named_suffixes(rules: list[tuple[str, str]]) -> set[str]:
    """The rules' domains and all that they end in."""
    out = set()
    for rule, _ in rules:
        labels = rule.partition("/")[0].split(".")
        out |= {".".join(labels[k:]) for k in range(len(labels))}
    return out


def suffix_of(host: str, named: set[str]) -> str:
    """The shortest suffix of a host that is not in `named`."""
    labels = host.split(".")
    for k in reversed(range(len(labels))):
        if (s := ".".join(labels[k:])) not in named:
            return s
    return ""


class UrlModel:
    """Statistics of host suffixes from a sample of all urls, and the trees grown on labelled ones.

    A host's suffix is the shortest one that is not in `named`. Training rows
    count as unseen urls do: their own url is left out of the statistics.
    """

    def __init__(self, urls: list[str], hosts: list[str], paths: list[str], y: np.ndarray, named: set[str] = frozenset(), everyone: tuple[list[str], list[str]] | None = None):
        self.named, self.seen = named, {}
        all_hosts, all_paths = everyone if everyone is not None else (hosts, paths)
        self.size = max(1, len(all_hosts))
        for h, p in zip(all_hosts, all_paths, strict=True):
            n, depth, length = self.seen.get(s := self.suffix(h), (0, 0, 0))
            self.seen[s] = (n + 1, depth + p.count("/"), length + len(p))
        self.trees = Trees().fit(np.hstack([features(urls, hosts, paths), self.statistics(hosts)]), y) if len(y) else None

    def suffix(self, host: str) -> str:
        return suffix_of(host, self.named)

    def statistics(self, hosts: list[str]) -> np.ndarray:
        out = np.zeros((len(hosts), 3))
        for row, h in zip(out, hosts, strict=True):
            n, depth, length = self.seen.get(self.suffix(h), (0, 0, 0))
            row[:] = np.log1p(10_000 * n / self.size), depth / max(1, n), length / max(1, n)
        return out

    def blocked(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        if self.trees is None or not urls:
            return np.zeros(len(urls))
        return self.trees.probability(np.hstack([features(urls, hosts, paths), self.statistics(hosts)]))


def _ruled(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """id, url, host, path, rule and verdict (null where no rule fits)."""
    host, path = host_and_path(F.col(quoted(url_col)))
    parsed = pages.select(F.col(quoted(id_col)), F.coalesce(F.col(quoted(url_col)).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else None
    return ruled.withColumn("verdict", F.element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string"))


def _cutoff(n: int, wanted: float, size: int) -> int:
    """A 64-bit number below which `wanted` of the hashes of n rows lie, and some more; the largest where that is half of them or more."""
    share = (wanted + 8 * size**0.5 + 100) / max(n, 1)
    return int(-(1 << 63) + share * (1 << 64)) if share < 0.5 else (1 << 63) - 1


def _drawn(ruled: DataFrame, sample: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Distinct labelled urls, and distinct urls of any kind, at most `sample` of each: those with the least seeded hashes.

    One pass counts both, one draws both: the cutoffs leave a little more than
    `sample` rows of each, whatever the number of urls or partitions.
    """
    told, first, second = F.col("verdict").isNotNull(), F.xxhash64(F.lit(SEED), "url"), F.xxhash64(F.lit(SEED + 1), "url")
    counted = F.xxhash64("url")
    sizes = ruled.agg(F.approx_count_distinct(F.when(told, counted), 0.02), F.approx_count_distinct(counted, 0.02)).head()
    below = [o <= F.lit(_cutoff(n, sample * 1.2, sample)) for o, n in zip((first, second), sizes, strict=True)]
    drawn = ruled.select("url", "host", "path", "verdict", first.alias("first"), second.alias("second")).where((told & below[0]) | below[1]).distinct().toPandas()
    labelled = drawn[drawn["verdict"].notna()].sort_values(["first", "url"]).head(sample)
    return labelled[["url", "host", "path", "verdict"]].reset_index(drop=True), drawn.sort_values(["second", "url"]).head(sample)[["url", "host", "path"]].reset_index(drop=True)


def _grown(labelled: pd.DataFrame, everyone: pd.DataFrame, rules: list[tuple[str, str]]) -> UrlModel:
    columns = (labelled[c].tolist() for c in ("url", "host", "path"))
    return UrlModel(*columns, (labelled["verdict"] == "block").to_numpy(float), named_suffixes(rules), (everyone["host"].tolist(), everyone["path"].tolist()))


def agreement(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, sample: int = SAMPLE, folds: int = 5) -> tuple[float, float]:
    """How often trees grown on other hosts give the rules' verdict, over the labelled sample, and how often the commoner verdict would."""
    labelled, everyone = _drawn(_ruled(pages, id_col, url_col, rules), sample)
    fold = np.array([zlib.crc32(h.encode()) % folds for h in labelled["host"]])
    right = 0
    for k in range(folds):
        held = labelled[fold == k]
        model = _grown(labelled[fold != k], everyone, rules)
        p = model.blocked(*(held[c].tolist() for c in ("url", "host", "path")))
        right += int(((p >= 0.5) == (held["verdict"] == "block").to_numpy()).sum())
    share = float((labelled["verdict"] == "block").mean()) if len(labelled) else 0.0
    return right / max(1, len(labelled)), max(share, 1 - share)


#: Features of the url alone, and with those of its suffix; settings of the trees as in `Trees`.
PLAIN, FEATURES = 19, [f"f{k}" for k in range(22)]
_LEARNER = Learner(FEATURES, "y", rounds=40, depth=3, step=0.2, rows_share=1.0, columns_share=1.0, weight=None, seed=SEED)


def _featured(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """`rows` with the features x of each url alone, and the suffix of its host."""
    named = named_suffixes(rules)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [frame[c].tolist() for c in ("url", "host", "path")]
            yield frame.assign(suffix=[suffix_of(h, named) for h in parts[1]], x=list(features(*parts)))

    kept = ", ".join(f"{quoted(c)} {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kept}, suffix string, x array<double>")


def _counted(rows: DataFrame) -> DataFrame:
    """For each suffix: its distinct urls, the steps and lengths of their paths, and n, the rows that have it. rows: distinct urls with `often`."""
    steps = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    return rows.groupBy("suffix").agg(F.count("*").alias("urls"), F.sum(steps).alias("steps"), F.sum(F.length("path")).alias("long"), F.sum("often").alias("n"))


def _with_statistics(rows: DataFrame, counted: DataFrame, size: int, *keep: str) -> DataFrame:
    """`keep` and all features, as numbers."""
    met = hot_join(rows, counted.drop("n"), ["suffix"], counted.select("suffix", "n"), "left")
    known = [F.log1p(F.lit(10_000.0) * F.col("urls") / F.lit(max(1, size))), F.col("steps") / F.col("urls"), F.col("long") / F.col("urls")]
    return met.select(*keep, *[x.alias(f) for x, f in zip([*(F.col("x")[k] for k in range(PLAIN)), *known], FEATURES, strict=True)])


def learned(ruled: DataFrame, rules: list[tuple[str, str]]) -> tuple[BoostedTrees | None, DataFrame, int]:
    """Trees grown on every distinct labelled url (None without any), the written counts of suffixes, and the number of distinct urls."""
    scratch = Scratch(ruled.sparkSession, "urls")
    distinct = ruled.groupBy("url", "host", "path", "verdict").agg(F.count("*").alias("often"))
    rows = scratch.table(_featured(distinct, rules), "urls")
    counted = scratch.table(_counted(rows), "suffixes")
    size, told = rows.agg(F.count("*"), F.count("verdict")).head()
    if not told:
        return None, counted, size
    labelled = rows.where("verdict is not null").withColumn("y", (F.col("verdict") == "block").cast("double"))
    model = _LEARNER.fit(scratch.table(_with_statistics(labelled, counted, size, "y"), "labelled"))
    scratch.drop("labelled")
    scratch.drop("urls")
    return model, counted, size


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """id, url, host, path, rule, verdict and score (of the trees; null where a rule decided)."""
    ruled = _ruled(pages, id_col, url_col, rules)
    model, counted, size = learned(ruled, rules)
    told = ruled.where("verdict is not null").withColumn("score", F.lit(None).cast("double"))
    free, keep = ruled.where("verdict is null").drop("verdict"), [quoted(id_col), "url", "host", "path", "rule"]
    scored = model.scored(_with_statistics(_featured(free, rules), counted, size, *keep), *keep) if model else free.withColumn("score", F.lit(0.0))
    return told.unionByName(scored.withColumn("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def op7_url_trees(spark, sf_dir: str) -> DataFrame:
    pages = without(spark.read.parquet(f"{sf_dir}/pages.parquet"), REPORT)
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")

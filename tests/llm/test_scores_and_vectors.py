"""Quality classifier, URL filter and embedding links."""

import math
import random

import numpy as np
import pytest
from hazardframe.llm import common, embedding_dedup, quality, urls
from pyspark.sql import functions as F

from .rows import WORDS, documents, frame
from .test_simhash import brute_components


def vectors(n=400, dim=16, labels=3, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    rows = []
    for k in range(n):
        v = base[k % len(base)] + rng.standard_normal(dim) * rng.choice([0.0, 0.15, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], int((k % len(base)) % labels)))
    odd = [None, [], [0.0] * dim, [math.nan] + [1.0] * (dim - 1), [math.inf] * dim, [None] + [1.0] * (dim - 1), [1.0] * (dim - 1)]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)]
    rows += [(1100, rows[5][1], None), (1101, rows[5][1], 2), (1102, rows[5][1], rows[5][2]), (1102, rows[5][1], rows[5][2]), (None, rows[7][1], rows[7][2]), (5, rows[9][1], rows[9][2])]
    rows += [(2000 + k, [float(np.float32(x * 3)) for x in rows[11][1]], rows[11][2]) for k in range(30)]
    return rows


def usable(r):
    return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])


def linked(a, b):
    if not (usable(a) and usable(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
        return False
    x, y = np.array(a[1]), np.array(b[1])
    return (x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= 0.93 or a[1] == b[1]


@pytest.mark.parametrize("bucket,exact", [(4096, False), (40, False), (12, True)])
def test_links_equal_brute_force(spark, bucket, exact):
    rows = vectors()
    roots = brute_components(rows, linked)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), sum(linked(r, s) for j, s in enumerate(rows) if j != i), str(least.get(c))) for i, (r, c) in enumerate(zip(rows, roots, strict=True)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.embedding_links(df, bucket=bucket, chunk=20, exact=exact).collect())
    links = sum(w[1] for w in want)
    if bucket == 4096 or exact:
        assert got == want
    else:  # several sets of projections: a link may be missed, none invented
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and sum(g[1] for g in got) >= 0.99 * links
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [64, 300])
def test_estimates_are_unbiased_within_the_bound(dim):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, dim))
    x[150:] = x[:150] + 0.3 * rng.standard_normal((150, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = embedding_dedup.Codes.of(x)
    everyone, real = slice(0, 300), x @ x.T
    error = codes.products(everyone, everyone) / codes.factor[:, None] - real
    assert abs(error[np.triu_indices(300, 1)].mean()) < 0.005 and np.abs(error).max() < 0.35
    for threshold in (0.5, 0.9):
        assert (codes.doubtful(everyone, everyone, threshold, True) >= (real >= threshold)).all(), "the exact bound misses nothing"
        assert (codes.doubtful(everyone, everyone, threshold, False) >= (real >= threshold)).mean() > 0.9999
    assert codes.doubtful(everyone, everyone, 0.93, False).mean() < 0.02, "few pairs are left in doubt"
    size = len(codes.signs[0].tobytes() + codes.planes[0].tobytes() + codes.numbers()[0].tobytes())
    assert dim < 300 or size < 8 * dim / 6
    again = embedding_dedup._codes([a.tobytes() + b.tobytes() + n.tobytes() for a, b, n in zip(codes.signs, codes.planes, codes.numbers(), strict=True)], dim)
    assert (again.products(everyone, everyone) == codes.products(everyone, everyone)).all()


def test_recall_in_a_large_label(spark):
    """Planted pairs just above the threshold, in a label of 10,000 vectors: many sets of buckets, and the exact way."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((9000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((1000, 64))
    side -= (side * base[:1000]).sum(axis=1)[:, None] * base[:1000]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.9301, 0.95, (1000, 1))
    x = np.concatenate([base, cos * base[:1000] + np.sqrt(1 - cos**2) * side])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    for exact, least in ((False, 0.99), (True, 1.0)):
        found = embedding_dedup.embedding_links(df, bucket=1024, exact=exact).agg({"n_links": "sum"}).head()[0]
        assert least * 2 * len(i) <= found <= 2 * len(i) and len(i) >= 1000


@pytest.mark.parametrize("often", [10_000, 500])
def test_a_label_does_not_depend_on_another(spark, monkeypatch, often):
    """A label that fits a bucket is compared whole beside one that does not, with MISS so large that sets of buckets lose links."""
    monkeypatch.setattr(embedding_dedup, "MISS", 0.5)
    monkeypatch.setattr(common, "OFTEN", often)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1900, 64))
    pairs = np.concatenate([base, base + 0.3 * rng.standard_normal((1900, 64))])
    label = [1] * 400 + [2] * 1500
    df = spark.createDataFrame([(k, v.tolist(), label[k % 1900]) for k, v in enumerate(pairs)], "vec_id long, embedding array<double>, label int").repartition(4)
    unit = pairs / np.linalg.norm(pairs, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    small = np.array([k % 1900 < 400 for k in range(3800)])
    want = int(near[np.ix_(small, small)].sum()) - 800
    links = lambda d: d.where("label = 1") if d is not df else d
    alone = embedding_dedup.embedding_links(links(df.select("*")), bucket=1024).agg({"n_links": "sum"}).head()[0]
    found = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(df, bucket=1024).collect()}
    assert alone == want == sum(found[k] for k in np.flatnonzero(small).tolist())
    large = sum(found[k] for k in np.flatnonzero(~small).tolist())
    assert large < int(near[np.ix_(~small, ~small)].sum()) - 3000, "the larger label is looked up in buckets"


def test_plan_grows_with_the_label():
    assert embedding_dedup.plan(100) == (1, 0)
    for n in (10_000, 10**6, 10**9):
        tables, bits = embedding_dedup.plan(n)
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - p) ** tables <= embedding_dedup.MISS and n / 2**bits <= embedding_dedup.BUCKET


def url_parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def test_urls(spark):
    random.seed(2)
    cases = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/x?y=http://a.b/c", "https://example.net/en/", "https://xexample.net/en/", "https://net", "https://net/", "https://NETx/", "a://b://c.net/d", "http://É.example.com/de/ü", "x\ny://m.org/fr/1\n2#z", "http://m.org?q=/fr/", "https://example.net/en"]
    cases += [f"https://{random.choice('ab')}.example.{t}/{p}/{random.randint(1, 999)}" + random.choice(["", "?page=2&ref=x", "#top"]) for t in ("net", "com", "org") for p in ("en", "de", "fr") for _ in range(30)]
    df = spark.createDataFrame([(k, u, "<p>", "h") for k, u in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    for k, u in enumerate(cases):
        host, path = url_parts(u)
        fits = [r for r, _ in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == dict(urls.RULES)[rule] if rule else got[k].verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_verdicts_vary_inside_a_domain(spark):
    rng = random.Random(6)
    made = [(k, f"https://{rng.choice(['a', 'www', 'm'])}.{rng.choice('klmnop')}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 9999)}") for k in range(3000)]
    made += [(3000 + k, made[0][1]) for k in range(1500)]
    df = spark.createDataFrame(made, "page_id long, url string")
    got = urls.judge_urls(df).where("rule is null").toPandas()
    for tld in ("com", "org"):
        mine = got[got["host"].str.endswith("." + tld)]
        assert {"allow", "block"} == set(mine["verdict"]), f"one verdict for all of .{tld}"
    met, common = urls.agreement(df)
    assert met > common + 0.05
    drawn = urls._drawn(urls._ruled(df, "page_id", "url", urls.RULES), 500)
    assert all(len(d) == 500 and d["url"].is_unique for d in drawn)


def test_all_urls_are_counted_and_learned_from(spark, monkeypatch):
    """Counts and trees came from at most 20,000 distinct urls."""
    monkeypatch.setattr(urls, "_drawn", lambda *a: pytest.fail("a sample is drawn"))
    rng = random.Random(9)
    made = [f"https://{rng.choice('abc')}.{rng.choice('kl')}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 200)}" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate([*made, None, "x"])), "page_id long, url string")
    ruled = urls._ruled(df, "page_id", "url", urls.RULES)
    model, counted, size = urls.learned(ruled, urls.RULES)
    named, want = urls.named_suffixes(urls.RULES), {}
    for u in {*made, "", "x"}:
        host, path = url_parts(u)
        n, steps, long = want.get(s := urls.suffix_of(host, named), (0, 0, 0))
        want[s] = (n + 1, steps + path.count("/"), long + len(path))
    assert {r.suffix: (r.urls, r.steps, r.long) for r in counted.collect()} == want and size == len({*made, "", "x"})
    assert counted.agg(F.sum("n")).head()[0] == 602
    told = ruled.where("verdict is not null").select("url", "verdict").distinct().toPandas()
    rate = (told["verdict"] == "block").mean()
    assert model.base == pytest.approx(np.log(rate / (1 - rate))) and len(model.trees) == 40
    got = urls.judge_urls(df).toPandas()
    assert len(got) == 602 and got["score"].isna().equals(got["rule"].notna()) and got["score"].dropna().between(0, 1).all()
    assert ((got["score"] >= 0.5) == (got["verdict"] == "block"))[got["rule"].isna()].all()


def test_trees_learn_held_out_urls():
    rng = random.Random(4)
    made = []
    for _ in range(4000):
        bad = rng.random() < 0.4
        host = rng.choice(["ads", "track", "win"]) + str(rng.randint(10, 99)) + ".example.org" if bad else rng.choice(["blog", "news", "docs"]) + ".example.com"
        path = "/" + "".join(rng.choices("0123456789abcdef", k=24)) if bad and rng.random() < 0.8 else "/en/" + "".join(rng.choices("abcdefgh", k=8))
        made.append((f"https://{host}{path}", host, path, float(bad)))
    train, test = made[:3000], made[3000:]
    model = urls.UrlModel(*(list(c) for c in list(zip(*train, strict=True))[:3]), np.array([m[3] for m in train]))
    p = model.blocked(*(list(c) for c in list(zip(*test, strict=True))[:3]))
    assert ((p >= 0.5) == np.array([m[3] for m in test])).mean() > 0.97


def test_hash_sample_is_bounded_and_stable(spark):
    from hazardframe.llm.common import hash_sample

    df = spark.range(5000).withColumnRenamed("id", "k")
    first = sorted(r.k for r in hash_sample(df.repartition(7), ["k"], 100, 3).collect())
    assert len(first) == 100 and first == sorted(r.k for r in hash_sample(df, ["k"], 100, 3).collect())
    assert hash_sample(df, ["k"], 9000, 3).count() == 5000


def test_isotonic_is_monotone_and_keeps_means():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= -1e-12).all() and abs(np.interp(x, knots, values).mean() - y.mean()) < 0.03


def test_fit_is_ridge_on_fourier_features(spark):
    """Moments, feature map, normal equations and calibration against plain numpy and the min-max form of isotonic regression."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 5)) * [1, 2, 3, 4, 0.1] + 7
    y = (x[:, 0] + rng.standard_normal(400) > 7).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(7)
    model = quality.fit(df, 5)
    draw = np.random.default_rng(quality.SEED)
    w, b = draw.standard_normal((5, quality.FEATURES)) / math.sqrt(2.5), draw.uniform(0, 2 * math.pi, quality.FEATURES)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -5, 5)
    phi = np.hstack([np.ones((400, 1)), z / math.sqrt(5), math.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b)])
    size = phi.shape[1]
    want = np.linalg.solve(phi.T @ phi + quality.RIDGE * 400 * np.eye(size) / size, phi.T @ y)
    raw = phi @ want
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    order = np.argsort(raw)
    ys, scores = y[order], raw[order]
    sums = np.concatenate([[0], np.cumsum(ys)])
    means = lambda j, k: (sums[k + 1] - sums[j]) / (k + 1 - j)
    fitted = np.array([max(min(means(j, k) for k in range(i, 400)) for j in range(i + 1)) for i in range(0, 400, 9)])
    first, last = np.searchsorted(scores, model.knots[1:-1]), len(model.knots) - 2
    assert (np.diff(model.values) >= 0).all() and last >= 2 and len(first) == last
    block = {round(float(v), 9) for v in model.values}
    assert all(round(float(v), 9) in block for v in fitted), "every fitted value is a block's mean"


def test_fourier_features_approximate_the_gaussian_kernel():
    model = quality.Model(4, features=40_000)
    z = np.random.default_rng(2).standard_normal((30, 4))
    phi = model.features(z)[:, 5:]
    distance = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    assert np.abs(phi @ phi.T - np.exp(-distance / 4)).max() < 0.03


def test_repeated_ids_and_labels(spark):
    rows = [(k % 3, "good words here " * (1 + k % 5), "en", "s", 1) for k in range(30)]
    labels = [(k, 1, 0) for k in range(3)] * 4 + [(0, 0, 0)]
    got = quality.quality_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 30 and all(0 <= r.score <= 1 for r in got)


def test_quality_of_held_out_rows(spark):
    random.seed(9)
    good = lambda: " ".join(random.choices(WORDS[:10], k=random.randint(20, 80))) + "."
    bad = lambda: " ".join(random.choice(WORDS) + random.choice(["###", "$$$", "%%"]) for _ in range(random.randint(20, 80)))
    rows = [(k, good() if k % 3 else bad(), "en", "s", 1) for k in range(600)] + [(9000 + (r[0] or 99), *r[1:]) for r in documents()]
    labels = [(k, int(k % 3 != 0), 0) for k in range(600)] + [(5, 1, 0), (None, 1, 0), (7, None, 0)]
    docs, known = frame(spark, rows, "score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, known).collect()}
    import zlib

    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(got) == len({r[0] for r in rows}) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[k].predicted == int(k % 3 != 0) for k in held) >= 0.97 * len(held)
    kept = quality.accepted(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted == 1}
    none = quality.quality_scores(docs, known.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.quality_scores(docs.limit(0), known).count() == 0


def test_trees_equal_brute_force():
    """Every cut of every feature tried at every node, with sums over masks; one leaf after the other."""
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 6, 300), rng.random(300).round(2), rng.standard_normal(300)]).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    trees = urls.Trees()
    trees.rounds = 6
    trees.fit(x, y)
    rate = y.mean()
    score, base = np.full(300, np.log(rate / (1 - rate))), np.log(rate / (1 - rate))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, trees.bins + 1)[1:-1])) for f in range(3)]
    for _ in range(6):
        p = 1 / (1 + np.exp(-score))
        g, w = y - p, p * (1 - p)
        gain = lambda rows: g[rows].sum() ** 2 / (w[rows].sum() + 1)  # noqa: E731, B023

        def grow(rows, depth):
            best, choice = 1e-6, None
            for f in range(3) if depth and rows.sum() >= 2 * trees.least else ():
                for cut in cuts[f]:
                    left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                    if min(left.sum(), right.sum()) >= trees.least and (found := gain(left) + gain(right) - gain(rows)) > best + 1e-12:  # noqa: B023
                        best, choice = found, (left, right)
            if choice is None:
                score[rows] += trees.rate * g[rows].sum() / (w[rows].sum() + 1)  # noqa: B023
            else:
                for side in choice:
                    grow(side, depth - 1)

        grow(np.ones(300, bool), trees.depth)
    assert np.allclose(trees.probability(x), 1 / (1 + np.exp(-score)), atol=1e-9) and trees.base == pytest.approx(base)
    assert ((trees.probability(x) > 0.5) == (y == 1)).mean() > 0.7

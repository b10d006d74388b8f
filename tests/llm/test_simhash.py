"""SimHash links against all pairs."""

import numpy as np
import pytest
import xxhash
from hazardframe.llm import simhash
from hazardframe.llm.common import Scratch
from hazardframe.llm.components import connected_components

from .rows import documents, frame


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(items))]


def test_near_duplicates_of_awkward_rows(spark):
    rows = documents()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f, str(least.get(c))) for r, f, c in zip(rows, fps, roots, strict=True))
    got = simhash.near_duplicates(frame(spark, rows, "f0")).collect()
    assert sorted((str(r.doc_id), r.f0 % (1 << 64), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("radius,group", [(3, 4096), (3, 40), (2, 40), (5, 4096)])
def test_links_against_all_pairs(spark, monkeypatch, radius, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base[:20].tolist():
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    named = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "f0 long, node long")
    scratch = Scratch(spark, "test")
    got = dict(map(tuple, connected_components(simhash.near_links(named, scratch, radius), scratch).collect()))
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    assert [got.get(k, k) for k in range(len(fps))] == want


def test_large_group_within_one_task():
    rng = np.random.default_rng(1)
    fps = (rng.integers(0, 2, (700, 64), dtype=np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    fps[300:600] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    group = np.sort(rng.integers(0, 3, 700))
    links = simhash.forest_links(group, fps, 3)
    want = brute_components(list(zip(group.tolist(), fps.tolist(), strict=True)), lambda a, b: a[0] == b[0] and (a[1] ^ b[1]).bit_count() <= 3)
    forest = simhash.Forest(700)
    assert len(forest.join(*map(np.array, zip(*links, strict=True)))) == len(links)
    assert len(set(forest.roots().tolist())) == len(set(want)) == 700 - len(links)


def test_bit_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 95, 96, 1000, 8192):
        rows = rng.integers(0, 2**63, (n, 2), dtype=np.uint64)
        want = [int(((rows[:, w] >> np.uint64(b)) & np.uint64(1)).sum()) for w in range(2) for b in range(64)]
        assert simhash.bit_counts(rows).tolist() == want


def test_similar_texts_meet_and_others_stay(spark):
    import random

    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(800)]
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    rows, pairs, far = [], [], []
    for k in range(150):
        words = random.choices(vocabulary, k=random.randint(60, 300))
        rows.append((2 * k, " ".join(words), "en", "s", 1))
        for _ in range(random.choice([0, 1, 1, 2, 30])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((2 * k + 1, " ".join(words), "en", "s", 1))
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        j = len(a & b) / len(a | b)
        (pairs if j >= 0.8 else far if j < 0.45 else []).append(2 * k + 1)
    kept = simhash.drop_near_duplicates(frame(spark, rows + [(None, None, None, None, None), (1000, rows[6][1], "en", "s", 1)]))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(pairs) > 60 and len(far) > 10
    assert all(2 * k in ids for k in range(150)) and all(f in ids for f in far) and None in ids
    assert sum(p in ids for p in pairs) <= 0.02 * len(pairs)


def five_words(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(five_words(a) & five_words(b)) / len(five_words(a) | five_words(b))


def test_texts_below_the_similarity_stay(spark):
    rng = np.random.default_rng(21)
    rows, near = [], 0
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        rows.append((2 * k, " ".join(words), "en", "s", 1))
        for j in rng.choice(40, 4 + k % 4, replace=False) * 5:  # five shingles each: Jaccard 0.70 to 0.82
            words[j] = f"x{k}"
        rows.append((2 * k + 1, " ".join(words), "en", "s", 1))
        near += jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    rows += [(500, "a b c d e " * 99 + " ".join(f"y{k}" for k in range(60)), "en", "s", 1), (501, "a b c d e", "en", "s", 1)]
    want = {r[0] for r in rows if r[0] % 2 == 0 or r[0] == 501 or jaccard(r[1], rows[r[0] - 1][1]) < 0.8}
    assert 20 < near < 60
    got = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert not want - got and len(got - want) <= 0.1 * near


def test_pairs_at_the_similarity_are_found(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(500):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 8 if k < 250 else 104)]
        near = [*words, "more"] if k < 250 else [*words, *(f"v{x}" for x in rng.integers(0, 10**9, 25))]  # 4 of 5, 100 of 125 shingles
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(near), "en", "s", 1)]
        assert jaccard(rows[-1][1], rows[-2][1]) == 0.8
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == set(range(0, 1000, 2))


def test_shared_keys():
    rng = np.random.default_rng(9)
    shared = []
    for _ in range(200):
        x = rng.integers(0, 1 << 64, 125, np.uint64)
        shared.append((simhash.min_keys(x) == simhash.min_keys(x[:100])).sum())
    assert min(shared) > 0 and abs(np.mean(shared) / simhash.TABLES - 0.8**simhash.ROWS) < 0.03
    assert len(simhash.min_keys(x[:0])) == 0


@pytest.mark.parametrize("group", [4096, 20])
def test_confirmed_links_within_candidates(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(4)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 60)]]
    for _ in range(79):  # each of 80 is drawn from an earlier one, so chains run through all similarities
        words = list(texts[rng.integers(0, len(texts))])
        for j in rng.choice(60, rng.integers(1, 3), replace=False):  # one leaves Jaccard near 0.84, two near 0.7
            words[j] = f"x{rng.integers(0, 10**6)}"
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    want = brute_components(texts, lambda a, b: jaccard(a, b) >= 0.8)
    docs = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)])
    if group == 4096:  # the membership of all rows, from candidates to groups
        least = {}
        for k, c in enumerate(want):
            least.setdefault(c, k)
        got = {r.id: r.component_id for r in simhash.near_groups(docs).collect()}
        assert got == {k: least[c] for k, c in enumerate(want)}
    named = docs.selectExpr("xxhash64(text) h", "doc_id id", "60L shingles", "doc_id node")
    scratch = Scratch(spark, "test")
    links = simhash.confirmed_links(docs, "doc_id", "text", named, named.selectExpr("node", "0L component"), scratch, 0.8, 5, 42)
    got = dict(map(tuple, connected_components(links, scratch).collect()))
    assert [got.get(k, k) for k in range(80)] == want and 1 < len(set(want)) < 80


def test_components_of_long_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (None, 4)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()))
    assert found == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]}

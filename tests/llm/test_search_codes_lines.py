"""Ranked search, vector codes and line dedup against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hazardframe.llm import common, lexical, line_dedup, vector_codes
from pyspark.sql import functions as F

from .rows import WORDS, documents, frame

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k=10):
    """{(item, text): [(score, id), ..]} by the definition; null ids last."""
    tf = [Counter(TERM.findall(lowered(r[1]))) for r in docs]
    n = [sum(t.values()) for t in tf]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in tf for t in c)
    out = {}
    for item, text in set((i, t or "") for i, t in items):
        asked, rows = Counter(TERM.findall(lowered(text))), []
        for r, c, size in zip(docs, tf, n, strict=True):
            score = 0
            for term, times in asked.items():
                if c[term]:
                    m = 25 + 75 * size * n_docs // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                rows.append((score, r[0]))
        out[item, text] = sorted(rows, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return out


ITEMS = [(1, "the PUMP pump über relief's"), (2, "pressure ¿qué? valve 42 42 word"), (3, None), (4, ""), (5, "nowhere found"), (6, "日本語 é odd"), (None, "gas flare"), (7, "gas flare"), (7, "line gas"), (1, "the PUMP pump über relief's"), (8, "word"), (9, "release of gas " * 3000)]


@pytest.mark.parametrize("shard,at_once,k", [(4096, 1024, 10), (5, 3, 10), (3, 1024, 1), (7, 1, 100)])
def test_search_is_exact(spark, tmp_path, monkeypatch, shard, at_once, k):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "STEP", 4)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(lexical.build_index, "__defaults__", lexical.build_index.__defaults__)
    rows = documents()
    lexical.build_index(frame(spark, rows, "terms"), f"{tmp_path}/i")
    index = spark.read.schema(lexical.INDEX_DDL).parquet(f"{tmp_path}/i")
    asked = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, rank int")
    got = defaultdict(list)
    for r in lexical.search(index, asked, k).collect():
        got[r.item_id].append((r["rank"], r.score, r.doc_id))
    want = defaultdict(list)
    for (item, _), rows_ in ranked(rows, ITEMS, k).items():
        want[item] += [(j + 1, *x) for j, x in enumerate(rows_)]
    order = lambda d: {i: sorted(map(str, v)) for i, v in d.items() if v}
    assert order(got) == order(want)
    assert lexical.search(index.limit(0), asked).collect() == [] and lexical.search(index, asked.limit(0)).collect() == []


def test_blocks_of_least_error():
    """The dynamic program against all cuts of short lists."""
    rng, price, most = np.random.default_rng(1), 7, 4
    lists = [rng.integers(1, 30, n) for n in (1, 2, 3, 9, 1, 11, 8, 4, 4)]
    ends = np.cumsum([len(x) for x in lists])
    block_ends, upto = lexical.cut_blocks(np.concatenate(lists), ends, price, most)
    cost = lambda x, cut: sum((b - a) * x[a:b].max() - x[a:b].sum() + price for a, b in itertools.pairwise([0, *cut, len(x)]))
    first = 0
    for x, end, last in zip(lists, ends, upto, strict=True):
        mine = (block_ends[first:last] - (end - len(x))).tolist()
        assert mine[-1] == len(x) and all(b - a <= most for a, b in itertools.pairwise([0, *mine]))
        cuts = (c for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k))
        best = min(cost(x, c) for c in cuts if all(b - a <= most for a, b in itertools.pairwise([0, *c, len(x)])))
        assert cost(x, mine[:-1]) == best
        first = last


def test_search_skips_blocks():
    """With a full list of good answers, a shard of middling documents is hardly opened, and the answer is the same."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    docs = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(20, 200))) for _ in range(3000)]
    docs[1500:1512] = [" ".join(["w3 w250 w251 w252"] * 5)] * 12
    n_terms = sum(len(d.split()) for d in docs)
    batch = lexical._shard(list(range(3000)), [d.encode() for d in docs], 3000, n_terms)
    shard = lexical.Shard(batch.to_pylist()[0])
    own = np.array([shard.terms.index(t) for t in ("w3", "w250", "w251", "w252")])
    weights, best = np.array([500, 5000, 5100, 5200]), lexical.Best(10)
    shard.search(own, weights, best)
    ends = np.concatenate([[0], np.frombuffer(batch.to_pylist()[0]["list_ends"], "<i4")])
    total, scores = sum(int(ends[t + 1] - ends[t]) for t in own), np.zeros(3000, np.int64)
    for t, w in zip(own, weights, strict=True):
        span = slice(int(ends[t]), int(ends[t + 1]))
        scores[shard.docs[span]] += w * shard.impacts[span].astype(np.int64)
    want = sorted(zip(-scores, range(3000), strict=True))[:10]
    assert list(zip(-best.scores, best.ids, strict=True)) == want and shard.opened < total / 2


def test_impact_of_huge_documents():
    assert lexical.impact(np.array([1]), np.array([1 << 40]), 1 << 30, 1 << 60)[0] == 10**9 // (1000 + 8 * (25 + 75 * 2**70 // 2**60))


def lloyd(rows, parts=16, entries=64, rounds=2, scale=256):
    """({row number: (code, error)}, entries) by the definition, every distance measured anew."""
    good = [k for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return {}, None
    dim = parts * max(1, math.ceil(max(len(rows[k][1]) for k in good) / parts))
    whole = {k: [math.floor(scale * x) for x in rows[k][1]] + [0] * (dim - len(rows[k][1])) for k in good}
    width = dim // parts
    first = sorted(good, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[whole[k][p * width : (p + 1) * width] for k in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for k in good:
                held[nearest(whole[k], p)[1]].append(whole[k][p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(books[p])]
    out = {}
    for k in good:
        found = [nearest(whole[k], p) for p in range(parts)]
        out[k] = (bytes(j for _, j in found).hex(), sum(d for d, _ in found))
    return out, books


def vector_rows(n=150, dim=32):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(np.float32(x)) for x in np.round(rng.standard_normal(dim), 1)], int(k % 3) if k % 7 else None) for k in rng.permutation(n)]
    rows += [(500, None, 1), (501, [math.nan] * dim, 1), (502, [math.inf] + [0.0] * (dim - 1), 1), (503, [None] * dim, 1), (504, [0.5] * 5, 1), (505, [], None), (506, [1e5, -1e5] * (dim // 2), 2)]
    return rows + [(None, rows[0][1], 1), (3, rows[1][1], 2), (3, rows[1][1], 2), (507, [-0.001] * dim, 2)]


@pytest.mark.parametrize("parts,entries,rounds,n", [(16, 64, 2, 150), (4, 7, 3, 150), (16, 64, 2, 5), (8, 5, 1, 60)])
def test_codes_equal_lloyd(spark, parts, entries, rounds, n):
    rows = vector_rows(n)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, code int").repartition(3)
    coded, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, entries_ = lloyd(rows, parts, entries, rounds)
    assert books.entries.tolist() == entries_
    got = sorted((str(r.id), str(r.label), r.code.hex(), r.error) for r in coded.collect())
    assert got == sorted((str(rows[k][0]), str(rows[k][2]), *x) for k, x in want.items())
    assert vector_codes.compress(df.limit(0))[0].collect() == []


def test_heaps_pop_what_drift_reaches():
    """After small moves few members are popped, and every one of the others still has its nearest entry."""
    rng = np.random.default_rng(8)
    vectors = rng.integers(-1000, 1000, (4000, 8))
    entries = rng.integers(-1000, 1000, (2, 16, 4))
    books = vector_codes.Codebooks(entries, np.zeros((2, 16)))
    chunk = vector_codes.Chunk.first(list(range(4000)), [None] * 4000, vectors, books)
    shape, changes = entries.shape, np.zeros(2 * 16 * 4 + 2 * 16, np.int64)
    for p in range(2):
        vector_codes.add_up(changes, shape, p, chunk.codes(p), chunk.vectors[:, p], 1)
    popped = []
    for _ in range(15):
        books = books.moved(changes.astype(object))
        changes = np.zeros_like(changes)
        chunk = vector_codes.Chunk.read(chunk.row(), shape)
        popped.append(chunk.settle(books, changes))
        for p in range(2):
            assert (chunk.codes(p) == vector_codes.measured(chunk.vectors[:, p], books.entries[p])[0]).all()
            for a, b in itertools.pairwise([0, *chunk.ends[p].tolist()]):
                assert (np.diff(chunk.keys[p, a:b]) >= 0).all()
    assert 0 < popped[-1] < popped[0] / 2


def shared_lines(rows, least=40, docs=5):
    """[(id, text left, lines, dropped)] by the definition."""
    strip = " \t\n\x0b\x0c\r"
    keys = [[lowered(x.strip(strip)) for x in (r[1] or "").split("\n")] for r in rows]
    holders = defaultdict(set)
    for r, own in zip(rows, keys, strict=True):
        for key in own:
            if len(key) >= least:
                holders[key].add((r[0], r[1] or ""))
    top = {k: max((d for d, _ in h if d is not None), default=None) for k, h in holders.items() if len(h) >= docs}
    out = []
    for r, own in zip(rows, keys, strict=True):
        lines = (r[1] or "").split("\n")
        left = [x for x, key in zip(lines, own, strict=True) if key not in top or top[key] == r[0]]
        out.append((str(r[0]), "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    common_lines = [" ".join(rng.choices(WORDS, k=9)) + f" shared {k} " + "x" * 20 for k in range(6)] + ["ünïcödé " * 5 + "abcdef", "é" * 40, "é" * 39, " \t" + "Mixed CASE line of forty characters and more\r"]
    rows = []
    for k in range(60):
        lines = rng.choices(common_lines, k=rng.randint(0, 4)) + [" ".join(rng.choices(WORDS, k=rng.randint(1, 20))) for _ in range(rng.randint(0, 5))]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", "s", 1))
    rows += [(None, "\n".join(common_lines), "en", "s", 1), (None, common_lines[0], "en", "s", 1), (5, "\n".join(common_lines[:3]), None, None, None), (70, None, "en", "s", 1), (71, "", "en", "s", 1), (72, "\n\n", "en", "s", 1)]
    rows += [(73, ("mixed case line of forty characters and more\n" * 5000) + common_lines[1].upper(), "en", "s", 1)] + [rows[3]] * 30
    return rows + [(100 + k, "held by four documents alone, so that it stays everywhere", "en", "s", 1) for k in range(4)] + [(200, "held by one document, five times over, so that it stays\n" * 5, "en", "s", 1)]


@pytest.mark.parametrize("parts,often", [(4, 10_000), (40, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, parts, often):
    """Many range partitions cut the runs of common keys; a small OFTEN deals repeated rows."""
    rows = line_rows()
    monkeypatch.setattr(common, "OFTEN", often)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 4).lower())
    try:
        docs = frame(spark, rows, "__bitmap2").repartition(5)
        scratch = common.Scratch(spark, "test")
        docs = scratch.table(docs, "docs")
        left = {}
        got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(docs).collect())
        want = shared_lines(rows)
        assert got == [w[:2] for w in want]
        maps, repeats = line_dedup.keep_bitmaps(docs, scratch)
        assert repeats.count() <= 1 + (parts == 4) and {str(d): n for d, n in maps.select("doc", "n_dropped").collect()}.items() <= {(w[0], w[3]) for w in want if w[3]} | left.items()
        assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_runs_over_batches(size):
    """One sorted partition, cut into batches of any size, is decided as one."""
    rng = random.Random(size)
    rows = sorted(((rng.randint(0, 6) if rng.random() < 0.8 else 100 + k, 0, -rng.randint(0, 8), rng.randint(0, 1), rng.randint(0, 3)) for k in range(200)))
    rows = [(a, b, -c or None, d, e) for a, b, c, d, e in rows]  # doc 0 stands for null, which comes last
    rows = [*rows, rows[-1]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], line_dedup._LINES[:5]) for k in range(0, len(rows), size)]
    out = [tuple(r.values()) for b in line_dedup._streamed(iter(batches), 5) for r in b.to_pylist()]
    holders = defaultdict(list)
    for h, _, doc, mark, pos in rows:
        holders[h].append((doc, mark, pos))
    first, last = rows[0][0], rows[-1][0]
    for h, held in holders.items():
        docs, top = len({x[:2] for x in held}), held[0][0]
        dropped = sorted(str(x[3:]) for x in out if x[0] == line_dedup.DROP and x[1] == h)
        is_open = sorted(str(x[3:]) for x in out if x[0] == line_dedup.OPEN and x[1] == h)
        others = sorted(str(x) for x in set(held) if x[0] != top)
        assert dropped == (others if docs >= 5 and h != first else [])
        assert is_open == (sorted(map(str, set(held))) if h == first else others if h == last and docs < 5 else [])
        assert [(x[3], x[5]) for x in out if x[0] == line_dedup.RUN and x[1] == h] == ([(top, docs)] if h in (first, last) else [])


def test_bitmaps():
    for dropped, n in (([0], 1), ([3, 1], 9), (list(range(0, 900, 7)), 901)):
        keep = line_dedup.kept_lines(line_dedup._bitmap(dropped), n)
        assert np.flatnonzero(~keep).tolist() == sorted(dropped)
    assert line_dedup.kept_lines(None, 3).all() and len(line_dedup._bitmap(list(range(100_000)))) < 200


def test_hot_join_deals_repeated_rows(spark):
    """A third of all rows is one row, repeated in every column: it is spread over tasks."""
    scratch = common.Scratch(spark, "test")
    rows = spark.range(90_000, numPartitions=3).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    rows = scratch.table(rows, "rows")
    counts = scratch.table(rows.groupBy("k").agg(F.count("*").alias("n")), "counts")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for how in ("inner", "left"):
            met = common.hot_join(rows, counts.where("n > 1"), ["k"], counts, how)
            sizes = [r["count"] for r in met.where("k = 7").groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 30_001 and max(sizes) <= 2.5 * common.OFTEN / 2 and len(sizes) >= 2
            assert met.count() == (90_000 if how == "left" else 30_001)
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_digest_of_entries():
    books = vector_codes.Codebooks(np.array([[[1, -2], [3, 4]]]), np.zeros((1, 2)))
    assert books.digest() == hashlib.sha256(b"1,-2,3,4").hexdigest()

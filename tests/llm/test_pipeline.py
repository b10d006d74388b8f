"""The pipeline's stages on a small corpus, each against what its own input calls for."""

import os
import random

import pytest
from hazardframe.llm.common import Scratch

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def build(spark, folder):
    random.seed(21)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(900)]
    good = lambda n=None: " ".join(random.choices(vocabulary, k=n or random.randint(40, 150))) + "."
    passage = " ".join(random.choices(vocabulary, k=60))
    rows = [(k, good(), "en", f"s{k % 3}", 1) for k in range(120)]
    rows += [(200 + k, " ".join(w + "$$$" for w in good().split()), "en", "s0", 1) for k in range(60)]
    rows += [(300 + k, rows[k][1], "en", "s0", 1) for k in range(10)]
    for k in range(10, 20):
        words = rows[k][1].split()
        words[len(words) // 2] = "changed"
        rows.append((400 + k, " ".join(words), "en", "s1", 1))
    rows += [(500 + k, f"{good(70)} {passage} {good(70)}", "en", "s2", 1) for k in range(5)]
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < 200), 0) for k in [*range(120), *range(200, 260)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in rows}, passage


def test_stages(spark, tmp_path):
    texts, passage = build(spark, tmp_path)
    scratch, docs, kept = Scratch(spark, "test"), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        assert name == "packing" or docs.columns == COLUMNS
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert not ids["quality"] & set(range(200, 260)) and len(ids["quality"] & set(range(120))) >= 119
    assert ids["exact_dedup"] == ids["quality"] - set(range(10)) - {600}  # the copies 300.. and the empty 601 have larger ids
    near = ids["exact_dedup"] - ids["near_dedup"]
    assert near <= set(range(410, 420)) and len(near) >= 9
    left = {r.doc_id: r.text for r in kept["passage_dedup"].collect()}
    assert passage in left[500] and not any(passage[10:-10] in left[k] for k in range(501, 505))
    assert ids["passage_dedup"] == ids["near_dedup"] - {600, 601} == ids["packing"]
    packed = kept["packing"].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sorted(r[1] for r in packed)[1:] == [2048] * (len(packed) - 1)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["packing"].count()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_near_stage_equals_brute_force(spark):
    """Five-word shingle sets of all pairs of documents: groups of Jaccard 0.8 or more leave the row with the least id."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        words = (r.text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    roots = list(range(len(rows)))

    def root(k):
        while roots[k] != k:
            k = roots[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) >= 0.8 * max(a, b) and (common := len(sets[i] & sets[j]), a + b - common)[0] >= 0.8 * (a + b - common):
                roots[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r.doc_id), r.doc_id)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, TABLES).select("doc_id").collect())
    assert got == sorted(least.values()) and len(got) < len(rows)

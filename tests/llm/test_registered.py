"""Every registered query of the subpackage on awkward tables, its whole contract against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hazardframe.llm.queries import QUERIES
from hazardframe.llm.tokens import tokenizer_path

from .rows import documents
from .test_passages import brute
from .test_scores_and_vectors import linked, url_parts, vectors
from .test_search_codes_lines import ITEMS, lloyd, ranked, shared_lines
from .test_simhash import brute_components

EXTRA = ["first", "a.dot", "component_id", "shard", "__key"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [*documents(), (66, "long word " * 2000, "en", "src0", 5)]  # 63 has 150,000 bytes
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    spark.createDataFrame([(*r, *range(len(EXTRA))) for r in rows], names).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int((r[0] or 0) % 2), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, u, None, 1) for k, u in enumerate(URLS)], "page_id long, url string, html string, rule int").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(*r, 1) for r in vectors(120)], "vec_id long, embedding array<float>, label int, kept int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, rank int").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


URLS = [None, "", "x", "https://a.net/en/1", "http://example.net/en/1?q", "https://example.com/de/3", "https://b.example.com/fr/", "https://c.org/fr/1", "https://c.org/en/1"] * 3


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def run(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


def texts(rows):
    return sorted((str(r[0]), r[1] or "") for r in rows)


def test_op1(spark, folder):
    out, (_, rows) = run(spark, "op1_external_shuffle", folder[0]), folder
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(by[k]) for k in range(24)]
    assert set(by) <= set(range(24)) and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_op2(spark, folder):
    out, (_, rows), lib = run(spark, "op2_deficit_packing", folder[0]), folder, library("word_bpe_49k.json")
    want, got, cover = defaultdict(int), defaultdict(int), defaultdict(list)
    ids = {}
    for d, t in texts(rows):
        ids[d] = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want[d] += len(ids[d])
    for r in out:
        got[str(r.doc_id)] += r.length
        cover[r.sequence_id].append((r.offset, r.length))
        part = ids[str(r.doc_id)][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[str(r.doc_id)]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert got == want
    for k in range(len(cover)):
        at = 0
        for offset, length in sorted(cover[k]):
            assert offset == at
            at += length
        assert at == 2048 or (k == len(cover) - 1 and at < 2048)


def test_op3(spark, folder):
    out, (_, rows) = run(spark, "op3_passages", folder[0]), folder
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows)


def test_op4(spark, folder):
    out, (_, rows) = run(spark, "op4_simhash", folder[0]), folder

    def mark(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(r[1]) for r in rows]
    roots = brute_components(list(zip(rows, marks, strict=True)), lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{m:016x}", str(least.get(c))) for r, m, c in zip(rows, marks, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want


def test_op5(spark, folder):
    out, (_, rows), lib = run(spark, "op5_bpe_round_trip", folder[0]), folder, library("byte_bpe_50k.json")
    want = []
    for d, t in texts(rows):
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)


def test_op6(spark, folder):
    out, (_, rows) = run(spark, "op6_fourier_quality", folder[0]), folder
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    assert sorted((str(r.doc_id), r.held_out) for r in out) == sorted((str(r[0]), held(r[0])) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_op7(spark, folder):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in run(spark, "op7_url_trees", folder[0]):
        host, path = url_parts(URLS[r.page_id])
        fits = [x for x in rules if ("." + host).endswith("." + x.split("/", 1)[0]) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits, key=len, default=None))
        assert r.verdict == rules[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_op8(spark, folder):
    out, (_, rows), lib = run(spark, "op8_token_files", folder[0]), folder, library("word_bpe_49k.json")
    n = lambda r: len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in out) == sorted((str(r[0]), n(r), zlib.crc32(np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [-math.inf if r.doc_id is None else r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order)


def test_op9(spark, folder):
    out, rows = run(spark, "op9_embedding_links", folder[0]), vectors(120)
    roots = brute_components(rows, linked)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), sum(linked(r, s) for j, s in enumerate(rows) if j != i), str(least.get(c)), r[0] == least.get(c)) for i, (r, c) in enumerate(zip(rows, roots, strict=True)))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == want


def test_op10(spark, folder):
    out, (_, rows) = run(spark, "op10_grace_dedup", folder[0]), folder
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(str(r[0]), str(keep[r[1] or ""]), len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in out) == sorted(want)


def test_op11(spark, folder):
    out, (_, rows) = run(spark, "op11_block_max_search", folder[0]), folder
    want = sorted(str((item, k + 1, doc, score)) for (item, _), found in ranked(rows, ITEMS).items() for k, (score, doc) in enumerate(found))
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in out) == want


def test_op12(spark, folder):
    out, rows = run(spark, "op12_heap_lloyd", folder[0]), vectors(120)
    found, books = lloyd(rows)
    by_label = defaultdict(int)
    for k, (_, error) in found.items():
        by_label[rows[k][2]] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out) == sorted((str(rows[k][0]), code, error, by_label[rows[k][2]], digest) for k, (code, error) in found.items())


def test_op13(spark, folder):
    out, (_, rows) = run(spark, "op13_line_bitmaps", folder[0]), folder
    want = [(d, n, gone, hashlib.sha256(left.encode()).hexdigest()) for d, left, n, gone in shared_lines(rows)]
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == sorted(want)


def test_pipeline_of_awkward_rows(spark, folder, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    from hazardframe.llm.common import Scratch

    docs, scratch = spark.read.parquet(f"{folder[0]}/documents.parquet"), Scratch(spark, "test")
    columns, rows = docs.columns, [r for r in folder[1]]
    for name, stage in pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, empty if name == "quality" else folder[0]), name)  # no labels: nothing is rejected
        if name == "exact_dedup":
            assert sorted(r.text or "" for r in docs.collect()) == sorted({r[1] or "" for r in rows})
        if name == "passage_dedup":
            assert docs.where("text is null or text = ''").isEmpty() and docs.where("n_chars != length(text)").isEmpty()
        assert name == "packing" or docs.columns == columns
    assert docs.count() > 0 and pipeline.run(spark, empty).count() == 0

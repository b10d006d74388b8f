"""Sharding, packing, BPE, token files and exact dedup against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hazardframe.llm import bpe, exact_dedup, packing, sharding, token_output
from pyspark.sql import functions as F
from hazardframe.llm.tokens import TextEncoder, tokenizer_path

from .rows import documents, frame

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_exact_dedup_report(spark):
    rows = documents()
    got = exact_dedup.dedup_report(frame(spark, rows, "kept")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = exact_dedup.exact_dedup(frame(spark, rows))
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_grace_recursion_keeps_everything(tmp_path):
    import xxhash

    texts = [f"{i % 700}" * 50 for i in range(3000)]
    records = [[xxhash.xxh3_64_intdigest(t.encode()), t.encode(), k, 1, 1] for k, t in enumerate(texts)]
    out = {e[1]: (e[2], e[3]) for e in exact_dedup.grace(iter(records), 4000, str(tmp_path))}
    assert len(out) == 700 and all(out[t.encode()] == (max(k for k in range(i, 3000, 700)), len(range(i, 3000, 700))) for i, t in enumerate(texts[:700]))
    same_hash = [[5, b"a", 1, 1, 1], [5, b"b", 2, 1, 1], [5, b"a", 3, 1, 1]]
    assert sorted(e[1:4] for e in exact_dedup.grace(iter(same_hash), 1, str(tmp_path))) == [[b"a", 3, 2], [b"b", 2, 1]]
    assert not list(tmp_path.iterdir())


def test_shards_are_equal_and_gapless(spark, tmp_path):
    rows = documents()
    out = sharding.write_shards(frame(spark, rows, "shard"), str(tmp_path / "a"), 5, bucket_bytes=4000).select("doc_id", "text", "shard", "slot", "size").collect()
    assert sorted((str(r[0]), r[1] or "-") for r in out) == sorted((str(r[0]), r[1] or "-") for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 8
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    buckets = [spark.read.parquet(str(tmp_path / "a")).select("bucket", "pos", "row.*")]
    sharding.write_shards(frame(spark, rows).repartition(2), str(tmp_path / "b"), 5, bucket_bytes=4000)
    buckets.append(spark.read.parquet(str(tmp_path / "b")).select("bucket", "pos", "row.*"))
    first, again = (sorted((str(r.doc_id), r.text or "-", r.bucket) for r in b.collect()) for b in buckets)
    assert first == again and len({b for *_, b in first}) > 5
    order = [r.doc_id for r in buckets[0].orderBy("bucket", "pos").collect()]
    assert order != sorted(order, key=str)
    copies = spark.range(600).selectExpr("if(id % 3 = 0, id, 1) doc_id", "if(id % 3 = 0, concat('t ', id), 'one copy') text", "id % 3 first", "1 `a.dot`").drop("first").withColumn("first", F.lit(7))
    split = sharding.write_shards(copies, str(tmp_path / "d"), 4, bucket_bytes=600)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "d")).groupBy("bucket").count().collect()]
    assert split.columns[:4] == ["doc_id", "text", "a.dot", "first"] and sum(sizes) == 600 and max(sizes) < 120, "copies of one row are split"
    assert sorted(split.groupBy("shard").count().collect()) == [(k, 150) for k in range(4)]
    assert sharding.write_shards(frame(spark, rows).limit(0), str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize("window,segment", [(64, 40), (2048, 2)])
def test_packing_places_each_id_once(spark, window, segment):
    rows = documents()
    out = packing.pack(frame(spark, rows, "offset"), WORD, window=window, segment=segment, keep_ids=True).collect()
    lib = library(WORD)
    ids = defaultdict(list)
    for r in out:
        ids[r.row_id].append(r)
    texts = []
    for pieces in ids.values():
        pieces.sort(key=lambda r: r.start)
        data = b"".join(p.ids for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))] and len(data) == 4 * pieces[0].doc_tokens
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
        texts.append((str(pieces[0].doc_id), np.frombuffer(data, "<u4").tolist()))
    assert sorted(texts) == sorted((str(r[0]), [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for s in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        lengths.append(at)
    assert all(n == window for n in lengths[:-1]) and lengths[-1] <= window and sorted(sequences) == list(range(len(sequences)))


def test_packing_of_nothing_and_without_sources(spark):
    rows = documents()
    assert packing.pack(frame(spark, rows).limit(0), WORD).count() == 0
    alone = packing.pack(frame(spark, rows).drop("source"), WORD).agg({"length": "sum"}).head()[0]
    assert alone == sum(len(library(WORD).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert bpe.round_trip(frame(spark, rows).limit(0), BYTE).count() == 0
    assert exact_dedup.dedup_report(frame(spark, rows).limit(0)).count() == 0


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=7), st.integers(0, 20_000))
@settings(max_examples=60, deadline=None)
def test_queues_stay_within_a_token_of_their_shares(totals, position):
    given_ = packing.handed_over(totals, position)
    whole = sum(totals)
    position = min(position, whole)
    assert sum(given_) == position and all(0 <= g <= t for g, t in zip(given_, totals, strict=True))
    assert all(abs(g - position * t / whole) <= len(totals) for g, t in zip(given_, totals, strict=True))
    later = packing.handed_over(totals, min(whole, position + 64))
    assert all(b >= a for a, b in zip(given_, later, strict=True))
    takes = packing.deficit_rounds(np.array(totals), np.array(given_), np.array(later) - np.array(given_), 8)
    assert takes.sum() == sum(later) - position and (takes >= 0).all() and (takes.sum(axis=1)[:-1] == 8).all()


def test_mixture_of_every_window():
    totals = np.array([9000, 700, 300])
    takes = packing.deficit_rounds(totals, np.zeros(3), totals, 100)
    assert (np.abs(np.cumsum(takes, axis=0) - np.outer(np.arange(1, 101), [90, 7, 3])) <= 1).all()


def test_targets_that_differ_from_the_corpus():
    totals, weights = [1000, 1000, 1000, 500], [700, 200, 100, 0]
    takes = packing.deficit_rounds(np.array(totals), np.zeros(4), np.array(totals), 100, np.array(weights))
    given_ = np.cumsum(takes, axis=0)
    assert (np.abs(given_[:14] - np.outer(np.arange(1, 15), [70, 20, 10, 0])) <= 1).all(), "the targets hold in every window while all queues last"
    live = given_[15:22, 1] - given_[14, 1], given_[15:22, 2] - given_[14, 2]
    assert (np.abs(live[0] - 2 * live[1]) <= 3).all(), "then what is left is dealt in its proportions"
    assert (given_[29] == [1000, 1000, 1000, 0]).all() and (given_[-1] == totals).all() and (takes.sum(axis=1) == 100).all()
    for position in (0, 1, 99, 1400, 1429, 1500, 2999, 3000, 3001, 3499, 3500):
        assert sum(packing.handed_over(totals, position, weights)) == position


def test_packing_to_targets(spark):
    rows = [(k, "valve pump release gas " * 20, "en", f"s{k % 3}", 1) for k in range(60)]
    out = packing.pack(frame(spark, rows), WORD, window=100, segment=3, targets={"s0": 0.7, "s1": 0.2, "s2": 0.1})
    source = {r[0]: r[3] for r in rows}
    windows = defaultdict(lambda: defaultdict(int))
    for r in out.collect():
        windows[r.sequence_id][source[r.doc_id]] += r.length
    for w in range(20):  # s0 has 1,620 ids, enough for 23 windows
        assert all(abs(windows[w][s] - x) <= 1 for s, x in (("s0", 70), ("s1", 20), ("s2", 10)))
    total = sum(sum(w.values()) for w in windows.values())
    assert total == 60 * 81 and all(sum(windows[w].values()) == 100 for w in range(len(windows) - 1))
    few = packing.pack(frame(spark, rows), WORD, window=100, segment=3, queues=1)
    assert few.agg({"length": "sum"}).head()[0] == total, "sources beyond the queues share one"
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), WORD, targets={"s0": 1.5})


TEXTS = st.one_of(st.text(max_size=60), st.text("abthernion .,'\n\t 's12é_²ß|", max_size=80), st.sampled_from(["<|endoftext|>a <|startoftext|>", "x" * 3000, " " * 50, "don't we'll ", "日本語 テスト"]))


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_ids_are_the_library_s(text):
    for path, ids in ((WORD, _word().ids), (BYTE, _byte().encode)):
        assert ids(text).tolist() == _lib(path).encode(text, add_special_tokens=False).ids
    ids = _byte().encode(text)
    assert _byte().decode(ids) == _lib(BYTE).decode(ids.tolist(), skip_special_tokens=False) == text


_made = {}


def _lib(path):
    return _made.setdefault(path, library(path)) if path in _made else _made.setdefault(path, library(path))


def _word():
    if "w" not in _made:
        _made["w"] = TextEncoder(WORD)
    return _made["w"]


def _byte():
    if "b" not in _made:
        _made["b"] = bpe.ByteBPE(BYTE)
    return _made["b"]


@given(st.lists(st.integers(0, 50_256), max_size=30))
@settings(max_examples=200, deadline=None)
def test_decode_of_any_ids(ids):
    assert _byte().decode(np.array(ids, np.int64)) == _lib(BYTE).decode(ids, skip_special_tokens=False)


def test_round_trip_and_tables(spark):
    rows = documents()
    df = frame(spark, rows, "n_tokens")
    got = {(str(r.doc_id), r.decoded_sha256): (r.n_tokens, r.ids_sha256) for r in bpe.round_trip(df, BYTE).collect()}
    for r in rows:
        ids = _lib(BYTE).encode(r[1] or "", add_special_tokens=False).ids
        text = _lib(BYTE).decode(ids, skip_special_tokens=False)
        assert got[str(r[0]), hashlib.sha256(text.encode()).hexdigest()] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, BYTE), BYTE).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_token_files(spark, tmp_path):
    rows = documents()
    token_output.write_token_files(frame(spark, rows, "start"), str(tmp_path / "t"), WORD, shard_bytes=600)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_documents(spark, str(tmp_path / "t")).collect())
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*_lib(WORD).encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((at, r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    shards = [token_output.Shard(r.asDict()) for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert len(shards) > 3 and (shards[0].find(np.arange(10**6, 10**6 + 2000)) < 0).all()
    token_output.write_token_files(frame(spark, rows).limit(0), str(tmp_path / "e"), WORD)
    assert token_output.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_look_up_opens_the_shards_of_its_keys(spark, tmp_path):
    rows = [(k, f"valve {k} release", "en", "s", 1) for k in range(300)] + [(77, f"again {k}", "en", "s", 1) for k in range(150)] + [(None, f"none {k}", "en", "s", 1) for k in range(150)]
    path = str(tmp_path / "t")
    token_output.write_token_files(frame(spark, rows), path, WORD, shard_bytes=300)
    shards = spark.read.parquet(path)
    assert shards.agg({"n_docs": "max"}).head()[0] < 60, "a repeated or null key does not fill one shard"
    got = token_output.lookup(spark, path, [5, 77, 299, 10**9, 5, None]).collect()
    want = [(k, [*_lib(WORD).encode(t, add_special_tokens=False).ids, 2]) for k, t, *_ in rows if k in (5, 77, 299)]
    assert sorted((r.key, r.ids) for r in got) == sorted(want) and len({r.shard_id for r in got}) > 3
    assert len(token_output.shards_of(spark, path, np.array([5]))) <= 2 < shards.count()
    assert token_output.lookup(spark, path, []).count() == 0


@given(st.sets(st.integers(-(2**62), 2**62), max_size=500))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    index = token_output.PerfectHash.from_bytes(token_output.PerfectHash.build(keys).to_bytes())
    assert sorted(index.lookup(keys)) == list(range(len(keys)))


def test_many_texts_merge_each_word_once():
    import random

    from hazardframe.llm import tokens

    enc = tokens.TextEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    random.seed(4)
    plain = [c for c in map(chr, range(1, 0x480)) if tokens._PROSE.fullmatch(c)] + list(" \n.,") * 20
    other = list(map(chr, range(1, 0x480))) + list(" \n'") * 60 + ["中", "\x00", *enc.special]
    texts = ["".join(random.choice(c) for _ in range(random.randrange(40))) for _ in range(300) for c in (plain, other)] + ["", " ", "..", "It's O'LL. é"]
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    for together in (50, tokens.TOGETHER):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tokens, "TOGETHER", together)
            assert [x.tolist() for x in enc.many(texts)] == want
    assert enc.many([]) == []
    read, core = [], enc.core

    class Counting:
        def encode_ordinary(self, text):
            read.append(text)
            return core.encode_ordinary(text)

    enc.core = Counting()
    enc.many(["valve leak valve", "leak, leak"] * 50)
    assert sorted("".join(read).split("\0")) == ["", ",", "leak", "valve"]

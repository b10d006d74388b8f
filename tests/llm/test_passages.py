"""Passage removal against brute force over all strings."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hazardframe.llm import passages

from .rows import documents, frame


def brute(rows, length=50):
    first = {}
    for r in rows:
        t, o = (r[1] or "").encode(), passages.LAST if r[0] is None else r[0]
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, o), o)
    out = []
    for r in rows:
        t, o = (r[1] or "").encode(), passages.LAST if r[0] is None else r[0]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < o:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((str(r[0]), len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    random.seed(3)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(2, 9)))
    shared = [" ".join(word() for _ in range(random.randint(8, 30))) for _ in range(6)]
    rows = []
    for k in range(90):
        parts = [" ".join(word() for _ in range(random.randint(0, 25)))]
        for _ in range(random.randint(0, 3)):
            s = random.choice(shared)
            cut = random.randint(0, len(s) // 2)
            parts += [s[cut:], " ".join(word() for _ in range(random.randint(0, 10)))]
        rows.append((200 - k, " ".join(parts), "en", "src0", 1))
    rows += [(300, "ab" * 200, "en", "s", 1), (301, "ba" * 150, "en", "s", 1), (302, "x" * 49, "en", "s", 1), (303, "x" * 49, "en", "s", 1), (304, "y" * 50, "en", "s", 1), (305, "y" * 50 + "z", "en", "s", 1)]
    return rows


@pytest.mark.parametrize("most,part,often", [(64 << 20, 8 << 20, 9), (64 << 20, 3000, 9), (3000, 3000, 10**9), (400, 3000, 3), (60, 3000, 3)])
def test_report_equals_brute_force(spark, monkeypatch, most, part, often):
    """Blocks of whole signatures, of anchors, and split to the full depth."""
    monkeypatch.setattr(passages, "BLOCK_MOST", most)
    monkeypatch.setattr(passages, "OFTEN", often)
    monkeypatch.setattr(passages, "PART_BYTES", part)
    rows = corpus() + documents()
    rows = [r for r in rows if len(r[1] or "") < 50_000] + [(66, "word " * 3000, "en", "src0", 5), (67, "word " * 20, "en", "src0", 5)]
    got = passages.passage_report(frame(spark, rows, "n_spans")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)


def test_texts_left(spark):
    rows = corpus()
    got = {r.doc_id: r.text for r in passages.remove_passages(frame(spark, rows)).collect()}
    kept = {d: h for d, *_, h in brute(rows)}
    ascii_only = [d for d, t in got.items() if t.isascii()]
    assert len(got) == len(rows) and all(hashlib.sha256(got[d].encode()).hexdigest() == kept[str(d)] for d in ascii_only if dict((r[0], r[1]) for r in rows)[d].isascii())
    assert passages.passage_report(frame(spark, rows).limit(0)).count() == 0


@given(st.lists(st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=6), st.integers(3, 12))
@settings(max_examples=200, deadline=None)
def test_factors_against_search(texts, length):
    sizes = np.array([len(t) for t in texts])
    run = np.repeat(np.arange(len(texts)), sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.arange(len(texts)) // 2
    at = passages.earlier_factors(data, np.cumsum(sizes)[run] - np.arange(len(data)), owner[run], length)
    want, base = [], 0
    for k, t in enumerate(texts):
        want += [base + i for i in range(len(t) - length + 1) if any(t[i : i + length] in u for j, u in enumerate(texts) if owner[j] < owner[k])]
        base += len(t)
    assert at.tolist() == want


@given(st.binary(max_size=60), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_suffix_order(data, depth):
    order, rank = passages.suffix_ranks(np.frombuffer(data, np.uint8), depth)
    assert sorted(order.tolist()) == list(range(len(data)))
    assert [data[i : i + depth] for i in order] == sorted(data[i : i + depth] for i in range(len(data)))
    assert all((rank[i] == rank[j]) == (data[i : i + depth] == data[j : j + depth]) for i in range(len(data)) for j in range(i))


@given(st.lists(st.integers(0, 5), max_size=40))
@settings(max_examples=100, deadline=None)
def test_smaller_neighbours(values):
    v = np.array(values, int)
    group = np.arange(len(v)) // 13
    before, after = passages.smaller_neighbours(v, group)
    for i in range(len(v)):
        assert before[i] == max([j for j in range(i) if v[j] < v[i] and group[j] == group[i]], default=-1)
        assert after[i] == min([j for j in range(i + 1, len(v)) if v[j] < v[i] and group[j] == group[i]], default=-1)


@given(st.lists(st.text("ab ", max_size=120).map(str.encode), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_every_string_holds_an_anchor(texts):
    found = {}
    for k, (owner, at, h) in ((0, x) for x in passages._anchored(texts, 20, 9)):
        for o, p, x in zip(owner.tolist(), at.tolist(), h.tolist(), strict=True):
            found.setdefault(o, {})[p] = x
    seen = {}
    for o, t in enumerate(texts):
        for i in range(len(t) - 19):
            inside = sorted((p - i, x) for p, x in found.get(o, {}).items() if i <= p <= i + 11)
            least = min(inside, key=lambda y: y[1])
            assert seen.setdefault(t[i : i + 20], least[1]) == least[1]


def test_replacement_characters_outside_passages_stay(spark):
    passage = "a passage that both of these documents hold, fifty bytes and more"
    rows = [(1, passage, "en", "s", 1), (2, "x\ufffdy " + passage + " z\ufffd", "en", "s", 1)]
    got = {r.doc_id: r.text for r in passages.remove_passages(frame(spark, rows)).collect()}
    assert got == {1: passage, 2: "x\ufffdy  z\ufffd"}


def test_copies_of_a_passage_are_folded_before_they_are_cut(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = words(500)
    rows = [(k, words(60 + k) + passage + words(70)) for k in range(40)] + [(40, passage[100:300] + words(50)), (41, words(9) + passage[:200] + "-" + passage[201:])]
    counted = {}

    class Counting(passages.Scratch):
        def table(self, df, name, *args, **more):
            out = super().table(df, name, *args, **more)
            counted[name] = out.count()
            return out

    monkeypatch.setattr(passages, "Scratch", Counting)
    monkeypatch.setattr(passages, "BLOCK_MOST", 2000)
    rows = [(*r, "en", "s", 1) for r in rows]
    got = passages.passage_report(frame(spark, rows))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(brute(rows))
    assert counted["pieces"] < 40 * len(rows)  # 2,550 before copies were folded

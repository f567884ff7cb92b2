import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import max_tree as m

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k):
    words = [Counter(terms_of(t)) for _, t in rows]
    lens = [sum(w.values()) for w in words]
    n, total, df = sum(x > 0 for x in lens), sum(lens), Counter(t for w in words for t in w)
    out = []
    for item, text in set(items):
        if item is None:
            continue
        own, scores = Counter(terms_of(text)), []
        for (i, _), w, length in zip(rows, words, lens, strict=True):
            if not length:
                continue
            norm = 100 - 25 + (25 * length * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * w[t]) // (1000 * w[t] + 12 * norm)) for t, times in own.items() if w[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, items, k):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, rank int, score string, item_id long")
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(map(tuple, m.search(docs, asked, k).collect()), key=str)


@given(st.text(alphabet="aZé9 _-.\x00\x7f/:@[`{\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_terms(text):
    assert [w.decode() for w in m.words(text)] == terms_of(text)


@given(st.lists(st.dictionaries(st.integers(0, 199), st.integers(1, 4), min_size=1, max_size=150), min_size=1, max_size=6), st.lists(st.integers(0, 8000), min_size=1, max_size=8), st.integers(1, 5), st.sampled_from([0, 3_000_000]))
@settings(max_examples=200, deadline=None)
def test_best_first_is_exhaustive(lists, weights, k, floor):
    n, lens = 200, np.arange(200) % 9 + 1
    docs, tf = np.concatenate([sorted(x) for x in lists]), np.concatenate([[x[d] for d in sorted(x)] for x in lists])
    trees = m.Trees(np.arange(8) * 2, np.arange(len(lists)) * 2, np.cumsum([len(x) for x in lists]), docs, tf, lens, 200, int(lens.sum()))
    got = trees.search(np.arange(len(weights)), np.array(weights), floor, k)
    want = Counter()
    for x, w in zip(lists, weights, strict=False):
        for d, f in x.items():
            want[d] += w * ((1_000_000_000 * f) // (1000 * f + 12 * (75 + 25 * int(lens[d]) * 200 // int(lens.sum()))))
    every = sorted(((s, d) for d, s in want.items() if s > 0 and s >= floor), reverse=True)
    last = every[k - 1][0] if len(every) >= k else 0
    assert sorted(got, reverse=True) == [x for x in every if x[0] >= last]
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(m, "SHARD_DOCS", 7)
    monkeypatch.setattr(m, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(m, "TERMS_AT_ONCE", 4)
    monkeypatch.setattr(m, "WANTED", 3)


def test_matches_brute_force(spark, small_shards):
    import random

    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Ab", "ab", "1"]
    text = lambda n: draw.choice([" ", ". ", "_"]).join(draw.choice(vocabulary) for _ in range(draw.randint(0, n)))
    rows = [(i, text(20)) for i in range(120)]
    rows += [(None, text(9)), (None, None), (500, None), (501, ""), (502, "..."), (7, rows[7][1]), (503, "w1 " * 5000)]
    rows += [(1000 + i, "w1 w2 equal") for i in range(40)]  # ties over shards
    items = [(i, text(8)) for i in range(14)] + [(3, "w1"), (20, None), (21, "nowhere"), (22, "w1 w1 W1 w2"), (None, "w1"), (23, "equal w2"), (23, "equal w2")]
    for k in (1, 5, 20):
        assert run(spark, rows, items, k) == brute(rows, items, k)


def test_one_sided_and_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == []
    assert run(spark, [(1, "a")], [], 5) == []
    assert run(spark, [(None, None)], [(1, "a")], 5) == []
    rows = [(1, "a b"), (2, "a"), (3, "c")]
    assert run(spark, rows, [(9, "a")], 5) == brute(rows, [(9, "a")], 5)


def test_ranks_are_unique(spark, small_shards):
    found = defaultdict(list)
    for item, rank, _, score in run(spark, [(i, "a b") for i in range(30)] + [(30, "z")], [(1, "a"), (2, "b a")], 20):
        found[item].append((rank, score))
    assert {i: [r for r, _ in sorted(v)] for i, v in found.items()} == {1: list(range(1, 21)), 2: list(range(1, 21))}

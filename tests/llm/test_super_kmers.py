import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import super_kmers as m


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(rows):
    """[(doc_id, n_words, n_removed, kept words)]; a null id comes after all others."""
    first = defaultdict(lambda: m.LAST)
    lists = [(m.LAST if i is None else i, words_of(t)) for i, t in rows]
    windows = lambda w: (tuple(w[k : k + m.WINDOW]) for k in range(len(w) - m.WINDOW + 1))
    for d, w in lists:
        for x in windows(w):
            first[x] = min(first[x], d)
    out = []
    for (i, _), (d, w) in zip(rows, lists, strict=True):
        gone = set()
        for k, x in enumerate(windows(w)):
            if first[x] < d:
                gone.update(range(k, k + m.WINDOW))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, d int, spans string, copy string").repartition(5)


def run(spark, rows):
    return sorted(map(tuple, m.removal_digests(frame(spark, rows)).collect()), key=str)


def corpus(seed, n=60):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "the", "É", f"w{draw.randint(0, 400)}"])
    fresh = lambda k: [word() for _ in range(k)]
    passages = [fresh(k) for k in (50, 51, 60, 120, 49, 300)]
    rows = []
    for i in range(n):
        parts = fresh(draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            cut = draw.randint(0, len(p) // 2)
            parts += p[cut : cut + draw.randint(40, 200)] + fresh(draw.randint(0, 40))
        rows.append((draw.choice([i, i, i, 1000 - i, None, 5]), "".join(w + draw.choice([" ", "\n", "\t ", "\r\n", "\x0b"]) for w in parts)))
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [(3, rows[10][1]), (2000, rows[10][1]), (2001, rows[10][1]), (2002, None), (2003, ""), (2004, " \n"), (2005, "a " * 49), (None, rows[11][1]), (None, rows[11][1])]
        rows += [(2100 + i, "a " * (60 + i)) for i in range(4)] + [(2200, "a b " * 400), (2201, "b a " * 300)]  # texts that repeat themselves
        assert run(spark, rows) == brute(rows)


def test_frequent_passages_in_portions(spark, monkeypatch):
    monkeypatch.setattr(m, "PORTION", 4)
    monkeypatch.setattr(m, "WORDS_AT_ONCE", 300)
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(64)]
    rows = [(draw.randint(0, 90), " ".join([f"l{draw.randint(0, 3)}" for _ in range(draw.randint(0, 30))] + passage[draw.randint(0, 3) :] + [f"r{draw.randint(0, 3)}" for _ in range(draw.randint(0, 30))])) for _ in range(90)]
    assert run(spark, rows) == brute(rows)


def test_copies_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(i, text) for i in range(40)] + [(100 + i, text + f" end{i % 3}") for i in range(20)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == brute([(None, None)])


def test_super_kmers_cover_every_window_once():
    draw = random.Random(1)
    lists = [[b"%d" % draw.randint(0, 5) for _ in range(n)] for n in (0, 49, 50, 51, 200, 3, 90)]
    text, h, first, last = m.super_kmers(lists)
    got = [(t, k) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist(), strict=True) for k in range(a, b + 1)]
    assert got == [(t, k) for t, x in enumerate(lists) for k in range(len(x) - m.WINDOW + 1)]
    by = {}
    for t, a, b, minimiser in zip(text.tolist(), first.tolist(), last.tolist(), h.tolist(), strict=True):
        for k in range(a, b + 1):
            assert by.setdefault(tuple(lists[t][k : k + m.WINDOW]), minimiser) == minimiser


def test_window_numbers_are_exact():
    draw = random.Random(2)
    strings = [[b"%d" % draw.randint(0, 1) for _ in range(draw.randint(50, 60))] for _ in range(20)]
    strings += [s[:55] for s in strings[:10] if len(s) > 55]
    groups = np.array([i % 2 for i in range(len(strings))])
    number, of = m.window_numbers(groups, strings)
    windows = [(g, tuple(s[k : k + 50])) for g, s in zip(groups.tolist(), strings, strict=True) for k in range(len(s) - 49)]
    assert len(set(windows)) == len(set(number.tolist())) == len(set(zip(windows, number.tolist(), strict=True)))
    assert of.tolist() == [i for i, s in enumerate(strings) for _ in range(len(s) - 49)]


def test_texts_without_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, "before\n" + text + " after"), (3, "  short   text "), (4, None)]
    out = {r["doc_id"]: r["text"] for r in m.without_repeats(frame(spark, rows)).collect()}
    assert out == {1: text, 2: "before after", 3: "  short   text ", 4: None}
    assert m.without_repeats(frame(spark, rows)).columns == ["doc_id", "text", "d", "spans", "copy"]


@pytest.mark.parametrize("width", [1, 49, 50])
def test_short_texts_have_no_super_kmers(width):
    assert len(m.super_kmers([[b"x"] * width])[0]) == (width >= m.WINDOW)

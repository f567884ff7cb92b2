import re
import tracemalloc
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import collocations as m

KIND = "text string, lang string, doc_id long, rank int, phrase string, block string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    pieces = re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))
    return [x for p in pieces if (x := re.findall("[^\x20\x09]+", p))]


def brute(rows, least, longest=3, top=2000, inside=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    every = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in every.items():
        cuts = [((1_000_000 * a * a) // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        held = [b for (other, q), b in every.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= inside * a for b in held):
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def run(spark, rows, least, top=2000):
    df = spark.createDataFrame([(t, lang, 1, 2, "x", "y") for t, lang in rows], KIND)
    return sorted(map(tuple, m.collocations(df, least=least, top=top).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(m, "BLOCK_BYTES", 40)


@given(st.text(alphabet="aAbÉé .,;\n\t\r\x0b\x0c!-", max_size=60))
@settings(max_examples=300, deadline=None)
def test_normalised_texts_have_the_same_pieces(text):
    data = m.normalised(text)
    found = [p.split() for p in data.decode().split("\n")] if data else []
    assert found == pieces_of(text)
    if data:
        assert data.count(b" ") - data.count(b"\n") - 1 == sum(map(len, found))


def test_hashes_name_each_phrase_and_no_other():
    data = m.normalised("a b a b. a b c\nd")
    unique, codes, starts, hashes = m._hashes("en", data)
    words = [unique[c].decode() for c in codes]
    assert [words[i] for i in starts[0]] == ["a", "b", "a", "b", "a", "b", "c", "d"]
    assert [tuple(words[i : i + 2]) for i in starts[1]] == [("a", "b"), ("b", "a"), ("a", "b"), ("a", "b"), ("b", "c")]
    assert [tuple(words[i : i + 3]) for i in starts[2]] == [("a", "b", "a"), ("b", "a", "b"), ("a", "b", "c")]
    for n, (start, h) in enumerate(zip(starts, hashes, strict=True), 1):
        phrases = [tuple(words[i : i + n]) for i in start]
        assert len(set(phrases)) == len(set(h.tolist())) == len(set(zip(phrases, h.tolist(), strict=True)))
    assert len({x for h in hashes for x in h.tolist()}) == sum(len(set(h.tolist())) for h in hashes)


def test_a_block_is_hashed_in_slices_of_whole_pieces():
    data = m.normalised("a b a b. a b c\nd. " + "x y z, " * 40)
    for size in (1, 7, 50, 10_000):
        slices = list(m._slices(data, size))
        assert b"\n".join(slices) == data and (size >= len(data)) == (len(slices) == 1)
        assert m._counters("en", data, 30, size).tolist() == m._counters("en", data, 30, 10_000).tolist()


def test_memory_of_a_block_s_counters():
    data = b"\n".join(b" %d of the %d " % (i % 9973, i) for i in range(200_000))

    def peak(size):
        tracemalloc.start()
        m._counters("en", data, 30, size)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(len(data) // 8) < 0.5 * peak(len(data))


def test_slices_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE_BYTES", 30)
    rows = [("the new york, a new york city. of the new york city x " * 3, lang) for lang in ("en", None, "en")]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_matches_brute_force(spark, small_blocks):
    import random

    draw = random.Random(5)
    vocabulary = ["the", "of", "a", "x", "new", "york", "city", "É", "ü", " ", "-", "a.b", "Of"]
    rows = []
    for i in range(300):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(draw.randint(0, 40)))
        rows.append((text, draw.choice(["en", "en", "fr", None, "und"])))
    rows += [("new york city " * 30, "en")] * 7 + [(None, "en"), ("", None), ("...", "de"), (" ", "de")]
    for least in (3, 10):
        assert run(spark, rows, least) == brute(rows, least)
    assert run(spark, rows, 3, top=5) == brute(rows, 3, top=5)


def test_hot_passages_and_ties(spark, small_blocks):
    rows = [("very common passage here", "en")] * 400 + [(f"w{i} y{i}", "en") for i in range(50) for _ in range(10)] + [("y z " * 500, "fr")]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_crowded_sketch_loses_nothing(spark, small_blocks, monkeypatch):
    """With many parts, and counters that many phrases share, the counts stay exact."""
    monkeypatch.setattr(m, "PART", 8)
    rows = [(" ".join(f"w{(i * j) % 23}" for j in range(1, 20)), "en") for i in range(60)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_empty_tables(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(None, None), ("", "en"), ("one two", "en")], 10) == []

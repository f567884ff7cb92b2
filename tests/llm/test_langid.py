import itertools

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import langid


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    lens = np.array([3, 1, 4, 2])
    score, trans, start = rng.normal(size=(lens.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, pair = langid.marginals(score, lens, trans, start)
    want_pair, at = np.zeros((3, 3)), 0
    for n in lens:
        want, total, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(score[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
            for a, b in itertools.pairwise(path):
                own[a, b] += w
        np.testing.assert_allclose(p[at : at + n], want / total, atol=1e-9)
        want_pair += own / total
        at += n
    np.testing.assert_allclose(pair, want_pair, atol=1e-9)


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    text = {r.lang: r.text for r in docs.where("n_chars > 500 and lang in ('fr', 'de')").select("lang", "text").collect()}
    mixed = " ".join(text["fr"].split()[:40] + text["de"].split()[:40])
    (ws, p), = langid.label_words(model, [mixed])
    got = np.array(model.labels)[p.argmax(axis=1)]
    assert (got[: len(ws) // 3] == "fr").mean() > 0.8 and (got[-len(ws) // 3 :] == "de").mean() > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "123 !? ² ½", "en", 1), (None, "the of and", None, 1), (4, "der die das " * 60000, "de", 1), (4, "", "de", 1), (5, "the of and", "en", 1)], "doc_id long, text string, lang string, score int")
    model = langid.train([("de", ["der", "die", "das"] * 5), ("en", ["the", "of", "and"] * 5)])
    out = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert sorted(out, key=str) == sorted([(1, "und"), (2, "und"), (None, "en"), (4, "de"), (4, "und"), (5, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, model).collect())
    empty = docs.limit(0)
    assert langid.fit(empty) is None and langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 2)
    names = [f"l{i:02}" for i in range(70)]
    rows = [(100 * i + j, f"{chr(97 + i % 26)}{chr(97 + i // 26)}word same", n) for i, n in enumerate(names) for j in range(12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == names


def naive_predictions(model, texts):
    """Every feature looked up by itself, forward-backward word by word, one text after another."""
    most, k, m = (1 << 64) - 1, 0x110000, (1 << langid.BITS) - 1

    def row(h, kind):
        h = (h + kind) * 0x9E3779B97F4A7C15 & most
        return (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & most) >> 40) % m + 1

    def code(chars):
        h = 0
        for c in chars:
            h = (h * k + ord(c)) & most
        return h

    def emission(word):
        marked, rows = "\x02" + word + "\x03", [model.lexicon.get(word, 0)]
        rows += [row(code(c), 11) for c in word]
        rows += [row(code(marked[i : i + 2]), 12) for i in range(len(marked) - 1)]
        rows += [row(code(marked[i : i + 3]), 13) for i in range(len(marked) - 2)]
        for n in (2, 3, 4):
            if len(word) >= n:
                rows += [row(code(word[:n]), 20 + n), row(code(word[-n:]), 30 + n)]
        return sum(model.weights[r].astype(float) for r in rows)

    big, out = np.exp(model.trans), []
    for t in texts:
        words = langid.words_of(t)
        if not any(any(map(str.isalpha, w)) for w in words):
            out.append(("und", 0.0))
            continue
        e = [np.exp(s - s.max()) for s in map(emission, words)]
        forward, backward = [np.exp(model.start) * e[0]], [np.ones(len(model.labels))]
        for x in e[1:]:
            forward.append((forward[-1] / forward[-1].sum()) @ big * x)
        for x in e[:0:-1]:
            backward.append(big @ (x * backward[-1]))
            backward[-1] /= backward[-1].sum()
        p = [a * b / (a @ b) for a, b in zip(forward, backward[::-1], strict=True)]
        mean = np.mean(p, axis=0)
        out.append((model.labels[int(mean.argmax())], float(mean.max())))
    return out


def test_whole_query_against_a_naive_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], naive_predictions(model, [r.text for r in rows]), strict=True))
    for r in langid.identify(docs, model).collect():
        lang, score = want[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_training_follows_the_gradient_of_the_likelihood():
    """The expected counts that training uses, against differences of the enumerated likelihood."""
    rng = np.random.default_rng(6)
    score, trans, start, gold = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), [0, 2, 2, 1]

    def likelihood(score, trans, start):
        value = lambda path: start[path[0]] + sum(score[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
        return value(gold) - np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=4)))

    p, pair = langid.marginals(score, np.array([4]), trans, start)
    p[np.arange(4), gold] -= 1
    for a, b in itertools.pairwise(gold):
        pair[a, b] -= 1
    for x, g in ((score, p), (trans, pair), (start, p[0])):
        for at in np.ndindex(*x.shape):
            x[at] += 1e-5
            up = likelihood(score, trans, start)
            x[at] -= 2e-5
            down = likelihood(score, trans, start)
            x[at] += 1e-5
            assert abs(-g[at] - (up - down) / 2e-5) < 1e-6

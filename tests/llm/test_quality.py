import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality


def test_features_of_a_text():
    make = quality.Features()
    doc, feature, value = make(["The cat, the cat", None, "", "The cat, the cat"])
    assert set(doc) == {0, 3} and (feature[doc == 0] == feature[doc == 3]).all()
    assert abs((value[doc == 0] ** 2).sum() - 1) < 1e-9
    # the, cat, ","; the cat, cat ",", ", the"; X(x) shapes 1-3: Xx x , / Xx-x x-, ,-x x-x / Xx-x-, x-,-x ,-x-x
    assert len(feature[doc == 0]) == 3 + 3 + 3 + 4 + 3


def test_separates_and_keeps_clean_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg("predicted").alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in out}
    print(out)
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x y z", 5), (2, "", 5), (9, "a b " * 300000, 5)], "doc_id long, text string, score int")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, empty)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert quality.score(docs.limit(0), model).count() == 0
    ex = [(np.array([1, 2]), np.array([0.6, 0.8]), 1), (np.array([3]), np.array([1.0]), 0)] * 50
    w, b = quality.train(ex, (1.0, 1.0))
    assert w[1] > 0 and w[2] > 0 and w[3] < 0 and (w != 0).sum() == 3


def naive_features(text):
    """Counts of hashed 1- and 2-grams of words and 1- to 3-grams of shapes, in plain integers."""
    most = (1 << 64) - 1
    k, last = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    tokens = quality.TOKEN.findall(text or "")
    word = [quality.xxhash.xxh64_intdigest("w" + t.lower()) for t in tokens]
    shape = [quality.xxhash.xxh64_intdigest("s" + quality._shape(t)) for t in tokens]

    def row(h, kind):
        h = (h ^ kind) * k & most
        return ((h ^ (h >> 32)) * last & most) >> (64 - quality.BITS)

    two = lambda v: [(a * k + b) & most for a, b in zip(v, v[1:], strict=False)]
    three = [((a * k + b) * k + c) & most for a, b, c in zip(shape, shape[1:], shape[2:], strict=False)]
    count = {}
    for kind, hashes in ((1, word), (2, two(word)), (3, shape), (4, two(shape)), (5, three)):
        for h in hashes:
            count[row(h, kind)] = count.get(row(h, kind), 0) + 1
    value = {r: np.log1p(n) for r, n in count.items()}
    norm = sum(v * v for v in value.values()) ** 0.5
    return {r: v / norm for r, v in value.items()}


def naive_model(examples, shares):
    """FTRL-proximal, one coordinate after another."""
    z, n, bz, bn = {}, {}, 0.0, 0.0
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    weigh = lambda zi, ni: 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((b + ni**0.5) / a + l2)
    have = [sum(1 for _, y in examples if y == c) for c in (0, 1)]
    cost = [(shares[c] / (sum(shares) or 1)) ** 0.5 * len(examples) / max(1, have[c]) / 2 for c in (0, 1)]
    rng = np.random.default_rng(3)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(examples)):
            x, y = examples[i]
            w = {r: weigh(z.get(r, 0.0), n.get(r, 0.0)) for r in x}
            bias = -bz / ((b + bn**0.5) / a + l2)
            g0 = (1 / (1 + np.exp(-(sum(w[r] * v for r, v in x.items()) + bias))) - y) * cost[y]
            for r, v in x.items():
                g, old = g0 * v, n.get(r, 0.0)
                z[r] = z.get(r, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / a * w[r]
                n[r] = old + g * g
            bz += g0 - ((bn + g0 * g0) ** 0.5 - bn**0.5) / a * bias
            bn += g0 * g0
    return {r: weigh(z[r], n[r]) for r in z}, -bz / ((b + bn**0.5) / a + l2)


def test_whole_query_against_a_naive_one(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    learn = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    marks = sorted({(str(r.doc_id), r.doc_id, r.quality) for r in labels.collect() if learn(r.doc_id) and r.quality in (0, 1)})
    shares = tuple(float(sum(y == c for *_, y in marks)) for c in (0, 1))
    w, bias = naive_model([(naive_features(texts[i]), y) for _, i, y in marks if i in texts], shares)
    want = {i: 1 / (1 + np.exp(-(bias + sum(w.get(r, 0.0) * v for r, v in naive_features(t).items())))) for i, t in texts.items()}
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.held_out == (not learn(r.doc_id)) and r.predicted == int(r.score >= 0.7)

"""Language identification: a linear-chain CRF labels every word, documents follow from the words.

Words are runs of letters. A word's features are its character 1- to 3-grams, prefixes and
suffixes of 2 to 4 characters and its entry in a lexicon learned from the training texts;
all are hashed into one table of weights per language. Transitions are learned from
sequences that switch language half way. Forward-backward over whole texts gives each
word's distribution; a document's is the mean over its words.

fit() learns every language from a bounded sample of its rows, TRAIN_DOCS per language, whole texts in
windows of HALF words; prediction covers everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, learnable, prepare, slices

TRAIN_DOCS, HALF = 120, 32  # the sample: texts per language; words of a window
BITS = 16
OFTEN = 3  # times that a language's words are in the sample for a place in the lexicon
STEPS = 40

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels; row 0 is zero
    trans: np.ndarray  # log potentials, labels x labels
    start: np.ndarray
    lexicon: dict[str, int]  # word -> row of weights


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Starts of the words in the flat arrays, flat n-gram rows, and rows per word (affixes, lexicon)."""
    flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    starts = np.cumsum(lens) - lens

    def row(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64((1 << BITS) - 1) + np.uint64(1)).astype(np.int64)  # 0 is no feature

    a, k = flat, np.uint64(0x110000)
    two = np.zeros_like(a)
    two[:-1] = a[:-1] * k + a[1:]
    three = np.zeros_like(a)
    three[:-2] = two[:-2] * k + a[2:]
    grams = [row(a, 11), row(two, 12), row(three, 13)]
    last = starts + lens - 1
    grams[0][starts] = grams[0][last] = 0
    grams[1][last] = 0
    grams[2][last] = 0
    grams[2][last - 1] = 0
    per_word = []
    for n in (2, 3, 4):
        fits = lens - 2 >= n
        for kind, begin in ((20, starts + 1), (30, last - n)):
            h = np.zeros(len(words), dtype=np.uint64)
            for i in range(n):
                h = h * k + a[np.where(fits, begin + i, 0)]
            per_word.append(np.where(fits, row(h, kind + n), 0))
    per_word.append(np.fromiter((lexicon.get(w, 0) for w in words), dtype=np.int64, count=len(words)))
    return starts, grams, np.stack(per_word)


def emissions(weights: np.ndarray, starts: np.ndarray, grams: list[np.ndarray], per_word: np.ndarray) -> np.ndarray:
    out = weights[per_word].sum(axis=0)
    for g in grams:
        out += np.add.reduceat(weights[g], starts, axis=0)
    return out


def marginals(score: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once.

    score: log emissions of all words, sequence after sequence; lens: words of each. Returns
    each word's distribution and the summed pairwise expectations (labels x labels). Step t
    handles every sequence longer than t; the sequences are sorted so that these come first.
    """
    labels = score.shape[1]
    order = np.argsort(-lens, kind="stable")
    first = (np.cumsum(lens) - lens)[order]
    longest = int(lens.max(initial=0))
    live = np.searchsorted(-lens[order], -np.arange(longest), side="left")  # sequences with more than t words
    e = np.exp(score - score.max(axis=1, keepdims=True))
    big = np.exp(trans)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    now = np.exp(start) * e[first[: live[0]]] if longest else None
    for t in range(longest):
        at = first[: live[t]] + t
        if t:
            now = (now[: live[t]] @ big) * e[at]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[at] = now
    pair = np.zeros((labels, labels))
    back = np.ones((live[-1], labels)) if longest else None
    for t in range(longest - 1, 0, -1):
        at = first[: live[t]] + t
        if len(back) < live[t]:
            back = np.concatenate([back, np.ones((live[t] - len(back), labels))])
        beta[at] = back
        step = e[at] * back
        into = step @ big.T
        prev = alpha[at - 1]
        z = (prev * into).sum(axis=1, keepdims=True)
        pair += big * (prev.T @ (step / z))
        back = into / into.sum(axis=1, keepdims=True)
    if longest:
        if len(back) < live[0]:
            back = np.concatenate([back, np.ones((live[0] - len(back), labels))])
        beta[first[: live[0]]] = back
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), pair


def train(samples: list[tuple[str, list[str]]], seed: int = 7) -> Model | None:
    """samples: (language, window of words). Full-batch Adam on the CRF's likelihood."""
    samples = sorted((lang, ws) for lang, ws in samples if ws)
    labels = sorted({lang for lang, _ in samples})
    if not labels:
        return None
    of = {lang: i for i, lang in enumerate(labels)}
    counts: dict[str, np.ndarray] = {}
    for lang, ws in samples:
        for w in ws:
            counts.setdefault(w, np.zeros(len(labels)))[of[lang]] += 1
    known = set()
    for i in range(len(labels)):
        known.update(w for w, c in counts.items() if c[i] >= OFTEN)
    lexicon = {w: (1 << BITS) + i for i, w in enumerate(sorted(known))}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    by_lang = [[i for i in order if samples[i][0] == lang] for lang in labels]
    seqs = []
    for n, i in enumerate(order):  # each window is followed by one of its own or of another language
        other = by_lang[of[samples[i][0]]] if n % 2 else order
        j = other[rng.integers(len(other))]
        seqs.append((samples[i], samples[j]))
    flat = [w for pair in seqs for _, ws in pair for w in ws]
    gold = np.array([of[lang] for pair in seqs for lang, ws in pair for _ in ws])
    lens = np.array([sum(len(ws) for _, ws in pair) for pair in seqs])
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    starts, grams, per_word = features(list(unique), lexicon)
    size, n_lab = (1 << BITS) + len(lexicon), len(labels)
    width = np.diff(np.append(starts, len(grams[0])))
    weights, trans, start = np.zeros((size, n_lab)), np.zeros((n_lab, n_lab)), np.zeros(n_lab)
    first = np.cumsum(lens) - lens
    inner = np.ones(len(flat), dtype=bool)
    inner[first] = False
    gold_pair = np.zeros((n_lab, n_lab))
    np.add.at(gold_pair, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    params, moment = [weights, trans, start], [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, trans, start)]
    for step in range(1, STEPS + 1):
        p, pair = marginals(emissions(weights, starts, grams, per_word)[codes], lens, trans, start)
        p[np.arange(len(gold)), gold] -= 1
        by_word = np.stack([np.bincount(codes, p[:, i], len(unique)) for i in range(n_lab)], axis=1)
        g = np.zeros_like(weights)
        for i in range(n_lab):
            for rows in per_word:
                g[:, i] += np.bincount(rows, by_word[:, i], size)
            spread = np.repeat(by_word[:, i], width)
            for rows in grams:
                g[:, i] += np.bincount(rows, spread, size)
        g[0] = 0
        grads = [g / len(lens) + 1e-5 * weights, (pair - gold_pair) / len(lens) + 1e-4 * trans, p[first].mean(axis=0)]
        for q, d, (m, v) in zip(params, grads, moment, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[0] = 0
    return Model(labels, weights.astype(np.float32), trans, start, lexicon)


def label_words(model: Model, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
    """The words of each text and each word's distribution over model.labels."""
    lists = [words_of(t) for t in texts]
    lens = np.array([len(x) for x in lists], dtype=np.int64)
    flat = [w for x in lists for w in x]
    if not flat:
        return [(x, np.zeros((0, len(model.labels)))) for x in lists]
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    p, _ = marginals(emissions(model.weights, *features(list(unique), model.lexicon)).astype(np.float64)[codes], lens[lens > 0], model.trans, model.start)
    ends = np.cumsum(lens)
    return [(x, p[e - n : e]) for x, n, e in zip(lists, lens, ends, strict=True)]


def fit(docs: DataFrame) -> Model | None:
    """Learn from text and lang of rows that learnable() lets through; see the module's bounds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(learnable(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rank = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("id", "lang").withColumn("n", F.row_number().over(rank)).where(F.col("n") <= TRAIN_DOCS)
    ids = F.broadcast(ids.select("id").distinct())  # at most TRAIN_DOCS ids a language

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, text in zip(b["lang"], b["text"], strict=True):
                ws = words_of(text)
                out += [(lang, ws[i : i + HALF]) for i in range(0, len(ws), HALF)]
            yield pd.DataFrame(out, columns=["lang", "words"])

    prepare(spark)
    found = rows.join(ids, "id", "left_semi").select("lang", "text").mapInPandas(windows, "lang string, words array<string>")
    return train([(r.lang, list(r.words)) for r in found.collect()])  # bounded for each language


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row's whole text.

    Texts that are null or have no letter are `und` with score 0, and so is everything if
    there was nothing to learn from. Ties go to the label that sorts first. Repeated rows
    are predicted alike; a null doc_id is not held out (and never learned from); columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)  # 2^BITS rows and those of the sample's words

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            texts = b.tolist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in slices(texts) if m else ():
                for i, (ws, p) in enumerate(label_words(m, texts[lo:hi]), lo):
                    if any(any(map(str.isalpha, w)) for w in ws):  # superscripts and fractions are no letters
                        mean = p.mean(axis=0)
                        best = int(mean.argmax())
                        lang[i], score[i] = m.labels[best], min(1.0, float(mean[best]))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    text = predict.asNondeterministic()(F.col("text").cast("string"))  # computed once for each row
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")

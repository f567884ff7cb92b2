import hashlib
import re
from collections import defaultdict

import pytest

from plumbline.llm import mixing


def fill(budget, kids):
    """kids: name -> (weight, cap); shares by weight, again and again until no cap is passed."""
    got, open_, left = {}, dict(kids), min(budget, sum(c for _, c in kids.values()))
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if left * w / total >= c - 1e-9}
        if not full:
            return got | {k: left * w / total for k, (w, _) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[1]
            left -= got[k]
    return got


def brute(rows, plan):
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        m = re.search(r"([0-9]+)$", source or "")
        if n:
            leaves["d" + str(int(m[1]) % 3) if m else "none", lang or "none", source or "none"].append((i, n))
    cap = {k: plan.epochs * sum(n for _, n in v) for k, v in leaves.items()}
    budgets = {(): int(sum(cap.values()) / plan.epochs * plan.share)}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for parent, b in budgets.items():
            kids = defaultdict(int)
            for k, c in cap.items():
                if k[:depth] == parent:
                    kids[k[: depth + 1]] += c
            new |= fill(b, {k: (getattr(plan, level).get(k[-1], plan.other), c) for k, c in kids.items()})
        budgets = new
    return leaves, budgets


@pytest.mark.parametrize("share, epochs", [(0.6, 2), (0.3, 1), (1.7, 2), (5.0, 2)])
def test_documents_against_brute_force(spark, share, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    plan = mixing.Plan(share=share, epochs=epochs)
    leaves, budgets = brute([tuple(r) for r in docs.collect()], plan)
    got = defaultdict(list)
    for r in mixing.selection(docs, plan).collect():
        got[r.domain, r.lang, r.source].append((r.epoch, r.doc_id, r.n_tokens, r.take_tokens))
    for leaf, texts in leaves.items():
        total, have = sum(n for _, n in texts), got[leaf]
        quota = sum(t for *_, t in have)
        assert abs(quota - budgets[leaf]) <= 3
        whole, rest = divmod(quota, total)
        order = sorted(texts, key=lambda x: (hashlib.md5(f"{plan.seed}:{whole}:{x[0]}".encode()).hexdigest(), x[0]))
        want = [(e, i, n, n) for e in range(whole) for i, n in texts]
        for i, n in order:
            if rest > 0:
                want.append((whole, i, n, min(n, rest)))
            rest -= n
        assert sorted(have) == sorted(want)
    assert sum(t for v in got.values() for *_, t in v) == min(int(sum(n for v in leaves.values() for _, n in v) * share), epochs * sum(n for v in leaves.values() for _, n in v))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "src1", 1), (2, "", None, None, 1), (None, "a b c", None, "x", 1), (4, "a b", "en", "src1", 1), (4, "a b", "en", "src1", 1), (5, "w " * 200_000, "fr", "src2", 1)], "doc_id long, text string, lang string, source string, epoch int")
    out = mixing.selection(docs, mixing.Plan(share=9.0, epochs=1)).collect()
    assert sorted((r.doc_id or 0, r.take_tokens) for r in out) == [(0, 3), (4, 2), (4, 2), (5, 200_000)]
    assert mixing.selection(docs.limit(0)).count() == 0
    assert mixing.mixed(docs, mixing.Plan(share=9.0, epochs=1)).columns == docs.columns


def test_texts_without_an_id_keep_the_budget(spark):
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * 9 + [str(i)]), "en", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = mixing.mixed(docs, mixing.Plan(share=0.5, epochs=1)).collect()
    assert len(kept) == 1500 and len({r.text for r in kept}) == 1500
    assert 400 < sum(r.doc_id is None for r in kept) < 600

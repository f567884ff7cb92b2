import uuid
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bm25 as m


def brute(rows, queries, k=10):
    words = [Counter(m.WORD.findall((t or "").lower())) for _, t in rows]
    lens = [sum(w.values()) for w in words]
    mean, n, df = sum(lens) / max(1, len(lens)) or 1.0, len(rows), Counter(t for w in words for t in w)
    out = []
    for q, text in set(queries):
        own = Counter(m.WORD.findall((text or "").lower()))
        terms = [t for t in own if t in df]
        scores = [(sum(m.bm25_score(w[t], df[t], length, n, mean) for t in terms if w[t]), i) for (i, _), w, length in zip(rows, words, lens, strict=True) if any(w[t] for t in terms)]
        out += [(q, i, s) for s, i in sorted(scores, key=lambda x: (-round(x[0], 9), x[1] is None, x[1] or 0))[:k]]
    return out


def same(got, want):
    a, b = defaultdict(list), defaultdict(list)
    for q, i, s in got:
        a[q].append((round(s, 6), i))
    for q, i, s in want:
        b[q].append((round(s, 6), i))
    assert {q: sorted(s for s, _ in v) for q, v in a.items()} == {q: sorted(s for s, _ in v) for q, v in b.items()}
    for q in b:  # ids above the last score, where rounding cannot swap equals
        low = min(s for s, _ in b[q])
        assert {x for x in a[q] if x[0] > low} == {x for x in b[q] if x[0] > low}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 200), st.integers(1, 4), min_size=1, max_size=150), min_size=1, max_size=9), st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=1, max_size=6), st.integers(1, 4), st.sampled_from([2, 8, 64]))
def test_pruned_search_is_exhaustive_search(lists, queries, k, width):
    n, lens = 201, np.arange(201) % 7 + 1
    docs = np.concatenate([sorted(x) for x in lists])
    tf = np.concatenate([[x[d] for d in sorted(x)] for x in lists])
    old, m.RANGE = m.RANGE, width
    try:
        shard = m.Shard(np.arange(len(lists)) * 3, np.cumsum([len(x) for x in lists]), docs, tf.astype(float), lens, 3.0)
        norm = m.K1 * (1 - m.B + m.B * lens / 3.0)
        idf = lambda t: 0.3 + t
        for floor in (0.0, 2.5):
            for way in ([[t for t in q] for q in queries],):
                terms = np.array([3 * t for q in way for t in sorted(q)])
                got = [set() for _ in queries]
                for q, d, s in shard.search(np.array([len(q) for q in way]), terms, np.array([idf(t // 3) for t in terms]), np.full(len(queries), floor), k):
                    for x in zip(q.tolist(), d.tolist(), np.round(s, 9).tolist(), strict=True):
                        got[x[0]].add(x[1:])
                for q, mine in zip(queries, got, strict=True):
                    want = Counter()
                    for t in q:
                        for d, f in lists[t].items() if t < len(lists) else ():
                            want[d] += idf(t) * f * (m.K1 + 1) / (f + norm[d])
                    every = {(d, round(s, 9)) for d, s in want.items()}
                    last = sorted((s for _, s in every), reverse=True)[k - 1] if len(every) >= k else 0
                    need = {x for x in every if x[1] >= max(last, floor) + 1e-8}
                    assert need <= mine <= {x for x in every if x[1] >= floor - 1e-6}
    finally:
        m.RANGE = old


def test_documents_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = m.search(docs, docs.where("doc_id % 20 = 0")).collect()
    same([(r.query_id, r.doc_id, r.score) for r in got], brute(rows, [r for r in rows if r[0] % 20 == 0]))
    assert all([r.rank for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == list(range(1, 1 + sum(r.query_id == q for r in got))) for q in {r.query_id for r in got})
    monkeypatch.setattr(m, "SHARD_DOCS", 7)
    again = m.search(docs, docs.where("doc_id % 20 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.score) for r in again) == sorted((r.query_id, r.rank, r.score) for r in got)


def test_odd_rows(spark):
    rows = [(20, "red apple"), (1, "red"), (2, None), (3, ""), (None, "apple"), (1, "red"), (40, "!!"), (60, "no such as this"), (20, "red apple"), (5, "pear " * 300_000), (80, "pear")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, term int")
    got = m.search(docs, docs.where("doc_id % 20 = 0")).collect()
    same([(r.query_id, r.doc_id, r.score) for r in got], brute(rows, [r for r in rows if r[0] and r[0] % 20 == 0]))
    assert m.search(docs.limit(0), docs).count() == 0 and m.search(docs, docs.limit(0)).count() == 0


def test_whole_queries_against_brute_force(spark):
    """No bound on a query's terms anywhere, neither here nor in the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = [Counter(m.WORD.findall((t or "").lower())) for _, t in rows]
    lens = [sum(w.values()) for w in words]
    df = Counter(t for w in words for t in w)
    want = []
    for q, text in rows[::20]:
        own = set(m.WORD.findall((text or "").lower()))
        scores = [(sum(m.bm25_score(w[t], df[t], n, len(rows), sum(lens) / len(lens)) for t in own if w[t]), i) for (i, _), w, n in zip(rows, words, lens, strict=True) if own & w.keys()]
        want += [(q, i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:10]]
    got = m.search(docs, docs.where(docs.doc_id.isin([i for i, _ in rows[::20]]))).collect()
    same([(r.query_id, r.doc_id, r.score) for r in got], want)


def test_long_queries_find_what_only_late_terms_share(spark, monkeypatch):
    query = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(query)), *[(i + 1, w) for i, w in enumerate(query)], (99, " ".join(query[:20])), (None, "w3 w4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in m.search(docs, docs.where("doc_id = 0"), k=100).collect()} == {i for i, _ in rows}
    got = sorted((r.rank, r.doc_id or -1, r.score) for r in m.search(docs, docs.where("doc_id = 0"), k=7).collect())
    for name, value in (("RANGE", 2), ("FREQUENT", 2), ("BLOCK_QUERIES", 1), ("SHARD_DOCS", 3), ("AT_ONCE", 1)):
        monkeypatch.setattr(m, name, value)
        assert sorted((r.rank, r.doc_id or -1, r.score) for r in m.search(docs, docs.where("doc_id = 0"), k=7).collect()) == got


def test_blocks_hold_a_term_once_and_shards_narrow_counts(spark):
    rows = [(i, f"same words in all w{i}") for i in range(40)] + [(40, "often " * 300 + "same"), (41, "most " * 70_000 + "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    shards = m.index(docs)
    s = shards.first()
    assert len(s.dfs) == 4 * len(s.terms) // 8 and len(s.tf) == 4 * len(s.docs) // 2
    block = m.query_blocks(docs.where("doc_id < 40"), shards, 42.0).first()
    assert len(block.q_terms) == len(block.idfs) == 8 * 44 and len(block.which) == 4 * 40 * 5
    for most, width in ((39, 1), (40, 2)):
        s = m.index(docs.where(f"doc_id <= {most}")).first()
        assert len(s.tf) == width * len(s.docs) // 2
    got = m.search(docs, docs.where("doc_id >= 38")).collect()
    same([(r.query_id, r.doc_id, r.score) for r in got], brute(rows, rows[38:]))


def test_ranges_multiplied_or_looked_at_one_by_one_and_lists_in_any_portions(monkeypatch):
    rng = np.random.default_rng(4)
    n, lists = 300, [np.sort(rng.choice(300, size, replace=False)) for size in (250, 200, 120, 60, 40, 20, 9, 5, 3, 2, 1) * 4]
    tf, lens = [rng.integers(1, 5, len(x)).astype(float) for x in lists], rng.integers(1, 9, n)
    shard = m.Shard(np.arange(len(lists)), np.cumsum([len(x) for x in lists]), np.concatenate(lists), np.concatenate(tf), lens, 4.0)
    idfs, norm, dense = rng.random(len(lists)) + 0.1, m.K1 * (1 - m.B + m.B * lens / 4.0), np.zeros((40, n))
    queries = [np.sort(rng.choice(len(lists), rng.integers(1, 30), replace=False)) for _ in dense]
    for q, mine in enumerate(queries):
        for t in mine:
            dense[q, lists[t]] += idfs[t] * tf[t] * (m.K1 + 1) / (tf[t] + norm[lists[t]])
    floor = np.partition(dense, -12, axis=1)[:, -12]
    for name, value in (("AT_ONCE", 128), ("MANY", -1), ("MANY", 1), ("CACHED", 1), ("CACHED", 500), ("POSTINGS", 1), ("AT_ONCE", 3)):
        monkeypatch.setattr(m, name, value)
        found = list(shard.search(np.array([len(q) for q in queries]), np.concatenate(queries), idfs[np.concatenate(queries)], floor, 5))
        query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        assert len(set(zip(query.tolist(), doc.tolist(), strict=True))) == len(query) and np.allclose(score, dense[query, doc], atol=1e-12)
        assert all((dense[q] > floor[q]).sum() <= (query == q).sum() == ((dense[q] >= floor[q] * m.SLACK) & (dense[q] > 0)).sum() for q in range(40))


def test_a_shard_is_unpacked_once_for_several_blocks(spark, monkeypatch, tmp_path):
    shard = m.Shard

    def counted(*arrays):
        (tmp_path / uuid.uuid4().hex).touch()
        return shard(*arrays)

    for name, value in (("Shard", counted), ("BLOCK_QUERIES", 1)):
        monkeypatch.setattr(m, name, value)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.shuffle.partitions": "24"}
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        docs = spark.createDataFrame([(i, f"word{i % 5} other{i % 3} term{i}") for i in range(24)], "doc_id long, text string").coalesce(1)
        assert m.search(docs, docs, 3).count() == 72
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert 0 < len(list(tmp_path.iterdir())) <= 24 // m.TOGETHER

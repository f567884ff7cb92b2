import hashlib
import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import suffix_dedup as s


def brute(rows, width=100):
    seen, out = {}, {}
    for d, text in sorted(set(rows), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.setdefault(w, 1)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def digests(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.removal_digests(df).collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=8), min_size=1, max_size=6), st.integers(0, 99))
def test_repeats_of_contexts(shape, seed):
    rng = random.Random(seed)
    pieces = [bytes(rng.choices(b"ab", k=rng.choice([40, 100, 130]))) for _ in range(6)]
    contexts = list(dict.fromkeys(b"".join(pieces[i] for i in c) for c in shape))
    first, want, n = {}, [], 0
    for c in contexts:
        own = []
        for i in range(len(c) - 99):
            own.append(first.setdefault(c[i : i + 100], n))
            n += 1
        want.append(own)
    got = s.repeats([contexts, contexts[:1]])
    assert [x.tolist() for x in got[0]] == want


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert digests(docs) == brute([tuple(r) for r in docs.collect()])


def _rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(20))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "x" * 5000), (104, "ab" * 300), (105, rows[3][1]), (106, rows[3][1] + "!"), (107, passage.encode()[7:].decode("utf-8", "ignore")), (108, passage * 3), (103, "x" * 5000)]
    return rows


def test_odd_rows_and_frequent_anchors(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_chars int, u string")
    want = brute(rows)
    assert digests(docs) == want
    monkeypatch.setattr(s, "PORTION", 3)
    assert digests(docs) == want
    kept = s.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    for r in kept.collect():
        assert r.n_chars == len(r.text or "") and r.u == "x"
        if want[r.doc_id][1] == 0:
            assert (r.text or "") == (dict(rows)[r.doc_id] or "")
    assert s.removal_digests(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "z" * 50 + "y" * 100), (5, "y" * 100)], "doc_id long, text string")
    assert digests(nulls)[None][1] == 100 and digests(nulls)[5][1] == 0


def test_hashing_goes_by_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcdefgh ", k=rng.choice([0, 50, 99, 100, 101, 400, 900]))) for _ in range(200)]
    data, size = s._flat(texts)
    want, hashes = s.anchors(data, size), s._string_hashes(data)
    for piece in (1, 333, 10_000_000):
        monkeypatch.setattr(s, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(s.anchors(data, size), want, strict=True))
        assert (s._string_hashes(data[:1000]) == hashes[:901]).all()
    assert [len(x) for x in s.anchors(*s._flat([]))] == [0] * 4 and len(s._string_hashes(data[:99])) == 0
    monkeypatch.undo()
    data, size = s._flat([rng.randbytes(2000) for _ in range(2000)])
    for run in (lambda: s.anchors(data, size), lambda: s._string_hashes(data)):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 60_000_000  # 4 MB of texts; all at once takes several times that
        tracemalloc.stop()

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.components import components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = {i: i for i, _ in rows}
    ids = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(len(rows)):
                if (fps[x] ^ fps[y]).bit_count() <= 4 and comp[ids[y]] > comp[ids[x]]:
                    comp[ids[y]] = comp[ids[x]]
                    changed = True
    return {(i, f"{f:016x}", comp[i]) for i, f in zip(ids, fps, strict=True)}


def test_pairs_of_the_index_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)], base ^ np.uint64(0b11111)]))
    group = (fp % np.uint64(3)).astype(int)
    ix = simhash.GrayIndex(group, fp)
    got = {(a, b) for i, j in ix.pairs() for a, b in zip(ix.order[i].tolist(), ix.order[j].tolist(), strict=True)}
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if a != b and group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want} and len(got) == len(want) / 2


def test_hash_is_sparks(spark):
    r = spark.sql("select xxhash64('the cat sat on') as h").first().h
    assert r % 2**64 == int(simhash.shingle_hashes("The cat\tsat  on")[0])


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_large_groups(spark, monkeypatch):
    long = "alpha beta gamma delta " * 250_000
    rows = [(5, None), (3, ""), (8, " \n"), (4, "a b"), (9, "A  b"), (9, "A  b"), (7, long), (6, long)]
    rows += [(100 + i, f"one two three four five six seven eight nine ten eleven twelve {i % 3}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    monkeypatch.setattr(simhash, "BLOCK", 2)
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == got
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {c for _, _, c in got} and out.count() == len({c for _, _, c in got})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "x y"), (1, "x y"), (None, "p q r s t")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(null).collect() if r.component_id) == [(False, 1), (True, 1)]


def test_components_of_a_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 900), (900, 950), (5, 5), (None, 3)], "a long, b long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {1000: 900, 900: 900, 950: 900}


def test_null_and_shared_ids_lose_only_near_duplicates(spark):
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (None, text(5)), (8, text(5)), (9, text(5)), (None, None), (None, "")]
    out = simhash.deduplicated(spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long"))
    assert out.columns == ["text", "doc_id"]
    got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
    assert got == sorted([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5)), (None, "")], key=str)


def test_masks_hold_every_near_pair_and_grow_with_the_table():
    rng = np.random.default_rng(4)
    for count in (1000, 1 << 24, 1 << 33, 1 << 40):
        chosen = simhash.masks(count)
        assert count >> min(m.bit_count() for m in chosen) <= simhash.BLOCK
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & m == 0 for m in chosen)
    assert len(simhash.masks(1000)) == 5 < len(simhash.masks(1 << 24)) == 15


def test_finer_groups_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "masks", lambda n, of=simhash.masks: of(1 << 24))
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == got


def test_rows_without_an_id_link_the_others(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(60):  # chains whose ends are apart
        fps.append(int(rng.integers(0, 2**62)))
        for _ in range(int(rng.integers(0, 6))):
            fps.append(fps[-1] ^ int(sum(1 << int(b) for b in rng.choice(62, 4, replace=False))))
    rows = [(None if i % 3 == 1 else i, f) for i, f in enumerate(fps)]
    rows += [(7, fps[6]), (None, fps[0])]  # repeated
    comp = list(range(len(rows)))
    for _ in range(12):
        for x in range(len(rows)):
            comp[x] = min(comp[y] for y in range(len(rows)) if (rows[x][1] ^ rows[y][1]).bit_count() <= 4)
    least = {c: min((r[0] for r, d in zip(rows, comp, strict=True) if d == c and r[0] is not None), default=None) for c in comp}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    key = lambda r: (r[1], r[0] is None, r[0] or 0, r[2] is None, r[2] or 0)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, f"{f:016x}", least[c]) for (i, f), c in zip(rows, comp, strict=True)], key=key)


def test_small_tables_have_files_by_their_rows(spark, monkeypatch):
    from pathlib import Path
    from urllib.parse import urlparse

    from plumbline.llm import components as c

    made = []
    keep = lambda *a, **b: made.append(stored(*a, **b)) or made[-1]
    stored = c.stored
    monkeypatch.setattr(c, "stored", keep)
    monkeypatch.setattr(c, "drop", lambda df: None)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r.node: r.component for r in components(edges).collect()} == {i: 1 for i in range(1, 61)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [len(list(Path(urlparse(df._plumbline_path).path).glob("part-*"))) for df in made[1:]]
    assert len(files) > 4 and set(files) == {1}

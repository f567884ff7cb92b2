from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from plumbline.llm import quality, simhash


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = p.stored(stage(spark, docs, d))
        seen[name] = (before, docs)
        if name != "bpe_encode":
            assert docs.columns == columns and docs.count() > 0
    before, after = seen["quality_classifier"]
    model = quality.fit(before, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good and len(good) < before.count()
    before, after = seen["simhash_near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after = seen["suffix_array_dedup"]
    assert after.count() == before.count()
    strings, n = set(), 0
    rows = {r.doc_id: r.text.encode() for r in after.collect()}
    for r in before.orderBy("doc_id").collect():  # brute force over the stage's own input
        data, gone = r.text.encode(), bytearray(len(r.text.encode()))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in strings:
                gone[i : i + 100] = b"\1" * 100
            strings.add(w)
        n += any(gone)
        assert rows[r.doc_id] == bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore").encode()
    assert n > 0
    before, after = seen["mix_to_weights"]
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert 0.75 < words(after) / words(before) < 0.9 and after.select("doc_id").distinct().count() == after.count()
    before, after = seen["bpe_encode"]
    lib = Tokenizer.from_file(p.VOCABULARY)
    ids = {r.doc_id: list(r.ids) for r in after.collect()}
    assert ids == {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids for r in before.collect()}
    assert sorted(tuple(r) for r in p.run(spark, d).select("doc_id", "n_tokens").collect()) == sorted((i, len(x)) for i, x in ids.items())


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, the empty table: no crash, whole columns."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = docs.orderBy("doc_id").first()
    extra = ["fp", "component_id", "h1", "row", "n_tokens", "score", "node", "kept_id"]
    rows = [(900_001, None, "en", "s1", 0), (900_002, "", None, None, 0), (None, good.text, "en", "s1", 1), (900_003, good.text, None, "s1", 1), (900_003, good.text, None, "s1", 1), (None, None, None, None, None), (900_004, (good.text + " ") * 3000, "en", "s1", 1)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    wide = odd.select("*", *[F.lit("x").alias(c) for c in extra])
    for name, stage in p.STAGES:
        out = p.stored(stage(spark, wide, d))
        n = out.count()
        assert 0 < n <= wide.count()
        assert out.columns == (["doc_id", "n_tokens", "ids"] if name == "bpe_encode" else wide.columns)
        if name in ("suffix_array_dedup", "bpe_encode"):
            assert n == wide.count()
        if name == "simhash_near_dedup":
            assert out.where("doc_id = 900003").count() <= 1
        empty = p.stored(stage(spark, wide.limit(0), d))
        assert empty.count() == 0 and empty.columns == out.columns

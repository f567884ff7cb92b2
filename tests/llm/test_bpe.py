import hashlib
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from plumbline.llm.bpe import Automaton, encode_documents, encoding_digests, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        return tokenizer(f.read()), Library.from_file(PATH)


def test_every_letter_and_space_as_the_library(both):
    own, lib = both
    text = " ".join(f"a{chr(c)}b" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn")
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aenrthisol'dséß Σ12!.%<|endoftext|>\n", max_size=60))
def test_texts_as_the_library(both, text):
    own, lib = both
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text(alphabet="ab", min_size=1, max_size=14))
def test_automaton_is_the_merge_loop(pairs, word):
    """Against plain merging with any small merge list, runs of one letter included."""
    vocab, merges = {"a": 0, "b": 1}, []
    for x, y in pairs:
        names = list(vocab)
        a, b = names[x % len(names)], names[y % len(names)]
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    rank, parts = {m: i for i, m in enumerate(merges)}, list(word)
    while (best := min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(99, 0)))[0] < 99:
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
    assert Automaton(vocab, merges).encode(word) == [vocab[p] for p in parts]


def test_documents(spark):
    long = "word " * 300_000
    rows = [(1, "Hello, world!", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello, world!", "x"), (None, "é ", "x"), (4, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r.doc_id, r.n_tokens) for r in encoding_digests(docs, PATH).collect()}
    lib = Library.from_file(PATH)
    assert out == {(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows}
    assert encoding_digests(docs.limit(0), PATH).count() == 0
    ids = {r.doc_id: list(r.ids) for r in encode_documents(docs, PATH).collect()}
    assert ids[1] == lib.encode("Hello, world!", add_special_tokens=False).ids and ids[2] == []
    digest = next(r for r in encoding_digests(docs, PATH).collect() if r.doc_id == 4)
    e = lib.encode(long, add_special_tokens=False).ids
    assert digest.ids_sha256 == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
    assert digest.decoded_sha256 == hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()

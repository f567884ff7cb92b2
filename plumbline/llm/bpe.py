"""BPE encoding and decoding by a token automaton that merge gadgets build one after another.

The automaton reads token labels. It starts with one state per base symbol and every arc
between them. The gadget of merge r, (u, v) -> w, changes it so:

* the state reached by u loses its arc v (that path now has to be one arc w);
* w becomes a label: every state that has an arc u, where the state of u has the arc v,
  gets an arc w; it ends in a new state that starts as a copy of v's state at that time.

States are stored as what a gadget changed (the copied state, the time, and the arcs taken
away), so 49,000 gadgets need two integers and one table entry each. A transition is
resolved once by going back through the gadgets and is then an entry of the transition
table. The result is deterministic: of all ways to write a word as tokens, exactly one is a
path, and so the state after each prefix of a word is one, too. Encoding walks a pre-split word
from left to right and looks up in that table, place by place, the one arc that leads from an
earlier place's state to this one; nothing is undone. The arcs into the word's end are its
tokens. Decoding follows the ids' arcs and emits their labels. Characters that came after
Python's Unicode tables count as symbols.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

#: White_Space of Unicode, which the pre-tokenizer's \s stands for.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"

#: Words kept with their encoding in one worker; the table is emptied when full.
WORDS_KEPT = 400_000
TRANSITIONS_KEPT = 1_000_000

#: A longer text is encoded in pieces of about this many characters, cut at white space.
PIECE = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return [chars[b] for b in range(256)]


class Automaton:
    """The token automaton of a vocabulary; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        n = max(vocab.values(), default=-1) + 1
        self.width = n
        self.label = [""] * n
        for s, i in vocab.items():
            self.label[i] = s
        self.born, self.copied, self.first = [-1] * n, [-1] * n, [-1] * n
        self.taken: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        self.dead: set[int] = set()
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        inner, final = {}, {}
        for s, i in vocab.items():
            if i in self.dead:
                continue
            if suffix and s.endswith(suffix):
                final[s[: -len(suffix)]] = i
            else:
                inner[s] = i
        self.inner, self.final = inner, final
        self.longest, self.longest_final = (max(map(len, d), default=0) for d in (inner, final))

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u in self.dead or v in self.dead or not self._resolve(u, v, rank):
            self.dead.add(w)  # no path u v is left: the label w is on no arc
        self.taken.setdefault(u * self.width + v, rank)
        self.born[w], self.copied[w], self.first[w] = rank, v, u

    def _resolve(self, state: int, label: int, before: int) -> bool:
        """Does the state of a token have the arc, seen just before the gadget of that rank?"""
        born, taken, width = self.born, self.taken, self.width
        while True:
            gone = taken.get(state * width + label)
            if gone is not None and gone < before:
                return False
            s, t = born[state], born[label]
            if s < 0 and t < 0:
                return True
            if s > t:  # the state was copied after the label came in
                state, before = self.copied[state], s
            else:  # the label came in on arcs of its first part; its own gadget counts
                label, before = self.first[label], t + 1

    def arc(self, state: int, label: int) -> bool:
        key = state * self.width + label
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TRANSITIONS_KEPT:
                self.table.clear()
            found = self.table[key] = self._resolve(state, label, 1 << 60)
        return found

    def encode(self, word: str) -> list[int]:
        """The ids of a word given as byte symbols."""
        n, table, width = len(word), self.table, self.width
        whole = (self.final if self.suffix else self.inner).get(word)
        if whole is not None:
            return [whole]  # the one arc from the start to the end
        state, begin = [-1] * (n + 1), [0] * (n + 1)  # after each prefix: the last arc's token, and where it began
        for end in range(1, n + 1):
            last = end == n and bool(self.suffix)
            labels, longest = (self.final, self.longest_final) if last else (self.inner, self.longest)
            for at in range(max(0, end - longest), end):
                t = labels.get(word[at:end])
                if t is None:
                    continue
                if at:
                    before = state[at]
                    if before < 0:
                        continue
                    found = table.get(before * width + t)
                    if not (self.arc(before, t) if found is None else found):
                        continue
                state[end], begin[end] = t, at
                break
        if n and state[n] < 0:
            raise ValueError(f"the vocabulary lacks a symbol of {word!r}")
        path, end = [], n
        while end:
            path.append(state[end])
            end = begin[end]
        return path[::-1]

    def decode(self, ids: list[int], between: str = "") -> str:
        """The labels of the arcs that the ids take."""
        return between.join([self.label[i] for i in ids])


class Tokenizer:
    """Normalising, pre-splitting and special tokens around the automaton, from a tokenizer file's JSON.

    Made for files with NFC and lower-case normalisers, a removing split and end-of-word
    marks, which is what word_bpe_49k.json has.
    """

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        m = d["model"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.automaton = Automaton(m["vocab"], pairs, m.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.texts = {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(x for x in d["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", SPACE))
        # Letters and digits younger than the library's Unicode are symbols to it: while words are
        # split, private-use characters stand for them.
        unknown = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
        young = regex.findall(r"[\p{L}\p{N}]", unknown)
        self.young = {ord(c): chr(0xF0000 + i) for i, c in enumerate(young)}
        self.back = {0xF0000 + i: c for i, c in enumerate(young)}
        self.late = frozenset(young)
        self.latin = regex.compile("[^\\x00-\u024f]")
        self.space = regex.compile(f"[{SPACE}]")
        self.symbols = byte_symbols()
        self.kept: dict[str, tuple[int, str, str]] = {}

    def _pieces(self, text: str) -> Iterator[str]:
        while len(text) > PIECE and (m := self.space.search(text, PIECE)):
            yield text[: m.start()]
            text = text[m.start() :]
        yield text

    def _word(self, word: str) -> tuple[int, str, str]:
        symbols = self.symbols
        ids = self.automaton.encode("".join([symbols[b] for b in word.encode()]))
        if len(self.kept) >= WORDS_KEPT:
            self.kept.clear()
        found = self.kept[word] = (len(ids), " ".join(map(str, ids)), self.automaton.decode(ids, " "))
        return found

    def runs(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        """(tokens, ids joined by a space, labels joined by a space) of each piece of a text."""
        if not text:
            return
        kept = self.kept
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield 1, str(self.special[part]), part
                continue
            for piece in self._pieces(part):
                late = False
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                    late = bool(self.latin.search(piece)) and not self.late.isdisjoint(piece)
                words = self.words.findall((piece.translate(self.young) if late else piece).lower())
                if late:
                    words = [w.translate(self.back) for w in words]
                found = [kept.get(w) or self._word(w) for w in words]
                if found:
                    n, ids, labels = zip(*found, strict=True)
                    yield sum(n), " ".join(ids), " ".join(labels)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.runs(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        label = self.automaton.label
        return " ".join([self.texts[i] if i in self.texts else label[i] for i in ids])


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """One automaton for each worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(spec)
    return _TOKENIZERS[key]


def _over(docs: DataFrame, vocabulary: str, schema: T.StructType, row) -> DataFrame:
    """Apply row(tokenizer, text) to every text; the vocabulary file is read by the driver only."""
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a fixed file of a few MB
    names = [f.name for f in schema.fields[1:]]
    arrow = [pa.int64() if f.dataType == T.LongType() else pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        for b in batches:
            made = [row(t, x) for x in b.column(1).to_pylist()]
            columns = zip(*made, strict=True) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, arrow, strict=True))], names=[b.schema.names[0], *names])

    return docs.select(F.col(schema.fields[0].name), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Key, n_tokens and ids (array of int) of every row's whole text.

    Null and empty texts have no tokens; rows are kept as they are, repeated ones too;
    columns other than the key and text are ignored. A key may be null.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def row(t: Tokenizer, text: str | None) -> tuple[int, list[int]]:
        ids = t.encode(text)
        return len(ids), ids

    return _over(docs, vocabulary, schema, row)


def encoding_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text (null: empty)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def row(t: Tokenizer, text: str | None) -> tuple[int, str, str]:
        total, ids, labels = 0, hashlib.sha256(), hashlib.sha256()
        for n, a, b in t.runs(text):
            if total:
                ids.update(b" ")
                labels.update(b" ")
            total += n
            ids.update(a.encode())
            labels.update(b.encode())
        return total, ids.hexdigest(), labels.hexdigest()

    return _over(docs, vocabulary, schema, row)

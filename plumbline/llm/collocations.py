"""Phrase collocations: candidates from sketch upper bounds, counted exactly by automata.

1. Texts become blocks of one language, normalised: lower case, one space around each word,
   a line end between pieces. A piece never crosses blocks, so neither do phrases.
2. Every phrase of 1 to LONGEST words of a block goes into a sketch: a table of counters, by
   a hash of language and phrase, that are never below the phrase's count. It has at least
   twice as many counters as the corpus has phrases and lies in parts, by ranges of the hash,
   which each sum up the blocks' shares; a share is at most `least`, since more is not asked.
   Phrases whose counter stays under `least` are no candidates. Each part tells each block
   which of its counters passed, so nobody needs the whole table.
3. The candidates of a slice of a block are compiled into an Aho-Corasick automaton (pyahocorasick).
   Its patterns begin and end with a space and the block's words have one on both sides, so a match
   never starts or ends within a word or crosses pieces. A scan counts all matches, overlapping
   ones too; counts are summed over the blocks, and what is under `least` goes now. What is
   left is exact: the sketch lets pass too much at times, never too little.
4. Scores, the rule on longer phrases and ranks are DataFrame operations on the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, prepare, stored

LEAST, LONGEST, TOP = 10, 3, 2000
SCALE = 1_000_000
INSIDE = 50  # per cent of a phrase's occurrences in one longer candidate, from which it goes
BLOCK_BYTES = 6_000_000
SLICE_BYTES = 1_000_000  # of a block, whose words are held as objects at once
PART = 1 << 22  # phrases of a part of the sketch, on average
SALTS = 32

#: A-Z in lower case; the separators of pieces as line ends; tabs as spaces.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def normalised(text: str) -> bytes:
    """Pieces with words, each between spaces and with one space between words, joined by line ends."""
    pieces = (p.split(b" ") for p in text.encode().translate(TABLE).split(b"\n"))
    return b"\n".join([b" " + x + b" " for p in pieces if (x := b" ".join(filter(None, p)))])


def blocks(docs: DataFrame) -> DataFrame:
    """block, lang, words and data (compressed normalised text), stored; words in all of a language are its n."""
    prepare(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # the same again if the task is run again
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            sizes.pop(lang)
            data = b"\n".join(held.pop(lang))
            words = data.count(b" ") - data.count(b"\n") - 1  # a piece has a space more than words
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([words]), pa.array([zstandard.compress(data, 1)], pa.binary())], names=["block", "lang", "words", "data"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = normalised(text)
                while data:  # a long text is cut between pieces
                    cut = data.find(b"\n", BLOCK_BYTES) if len(data) > BLOCK_BYTES else -1
                    part, data = (data, b"") if cut < 0 else (data[:cut], data[cut + 1 :])
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= BLOCK_BYTES:
                        yield block(lang)
                    elif sum(sizes.values()) >= 8 * BLOCK_BYTES:
                        yield block(max(sizes, key=sizes.__getitem__))
        for lang in list(held):
            yield block(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return stored(rows.mapInArrow(build, "block long, lang string, words long, data binary"))


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """A block's text in parts of about size bytes, cut between pieces (a piece stays whole)."""
    begin = 0
    while begin < len(data):
        cut = data.find(b"\n", begin + size)
        end = len(data) if cut < 0 else cut
        yield data[begin:end]
        begin = end + 1


def _hashes(lang: str, data: bytes) -> tuple[list[bytes], np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A slice's different words, its words as numbers, and for 1 to LONGEST words the starts and hashes of its phrases."""
    pieces = data.split(b"\n")
    words = data.replace(b"\n", b"").replace(b"  ", b" ").split(b" ")[1:-1]
    codes, unique = pd.factorize(np.array(words, dtype=object))
    seed = xxhash.xxh64_intdigest(lang.encode())
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in unique], np.uint64)[codes]
    ends = np.cumsum(np.array([p.count(b" ") - 1 for p in pieces]))
    end = np.repeat(ends, np.diff(ends, prepend=0))  # of each word's piece
    starts, hashes, own = [], [], h
    for n in range(1, LONGEST + 1):
        if n > 1:
            own = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
            own ^= own >> np.uint64(32)
        at = np.flatnonzero(np.arange(len(own)) + n <= end[: len(own)])
        mixed = own[at] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        starts.append(at)
        hashes.append(mixed ^ (mixed >> np.uint64(31)))
    return list(unique), codes, starts, hashes


def _counters(lang: str, data: bytes, bits: int, size: int) -> np.ndarray:
    """The sorted counters of a block's phrases, each as often as it occurs."""
    counter = np.concatenate([h >> np.uint64(64 - bits) for text in _slices(data, size) for h in _hashes(lang, text)[3]])
    counter.sort()
    return counter


def candidates(found: DataFrame, least: int = LEAST) -> DataFrame:
    """block, parts (array<struct<part, offsets>>): the counters of each block's phrases that reach least in the sketch."""
    words = found.agg(F.sum("words")).first()[0] or 0
    parts = max(0, (LONGEST * words // PART).bit_length())  # bits
    bits = max(parts + 8, (2 * LONGEST * words).bit_length())  # of a counter's number
    within = bits - parts

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, data in zip(b.column("block").to_pylist(), b.column("lang").to_pylist(), b.column("data"), strict=True):
                counter = _counters(lang, zstandard.decompress(data.as_buffer()), bits, SLICE_BYTES)
                head = np.flatnonzero(np.append(True, counter[1:] != counter[:-1]))
                share = np.minimum(np.diff(np.append(head, len(counter))), least).astype(np.uint8 if least < 256 else np.uint32)
                counter = counter[head]
                part = (counter >> np.uint64(within)).astype(np.int64)
                offset = (counter & np.uint64((1 << within) - 1)).astype(np.uint32)
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                cuts = np.append(first, len(part))
                values = [(offset[p:q].tobytes(), share[p:q].tobytes()) for p, q in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.full(len(first), block)), *(pa.array(list(x), pa.binary()) for x in zip(*values, strict=True))], names=["part", "block", "offsets", "shares"])

    kind = np.uint8 if least < 256 else np.uint32

    def passed(g: pa.Table) -> pa.Table:
        offsets = [np.frombuffer(x.as_buffer(), np.uint32) for x in g["offsets"]]
        shares = [np.frombuffer(x.as_buffer(), kind) for x in g["shares"]]
        every = np.concatenate(offsets)
        order = np.argsort(every, kind="stable")
        head = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        sums = np.add.reduceat(np.concatenate(shares)[order].astype(np.int64), head)
        ok = np.empty(len(every), bool)
        ok[order] = np.repeat(sums >= least, np.diff(np.append(head, len(every))))
        cuts = np.cumsum([0, *map(len, offsets)])
        left = [o[ok[p:q]].tobytes() for o, p, q in zip(offsets, cuts, cuts[1:], strict=False)]
        return pa.table({"block": g["block"], "part": g["part"], "offsets": pa.array(left, pa.binary())})

    told = found.select("block", "lang", "data").mapInArrow(shares, "part long, block long, offsets binary, shares binary")
    told = stored(told.groupBy("part").applyInArrow(passed, "block long, part long, offsets binary"), release=True)
    out = told.where(F.length("offsets") > 0).groupBy("block").agg(F.collect_list(F.struct("part", "offsets")).alias("parts"))
    out._plumbline_bits = bits, within
    out._plumbline_told = told
    return out


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of the phrases of 1 to LONGEST words with f >= least, and (lang, n), both stored."""
    found = blocks(docs)
    parts = candidates(found, least)
    bits, within = parts._plumbline_bits

    def passing(lang: str, text: bytes, ok: np.ndarray) -> list[str]:
        unique, codes, starts, hashes = _hashes(lang, text)
        phrases = []
        for size, (start, h) in enumerate(zip(starts, hashes, strict=True), 1):
            counter = h >> np.uint64(64 - bits)
            start = start[ok[np.minimum(np.searchsorted(ok, counter), len(ok) - 1)] == counter]
            own = _distinct([codes[start + i] for i in range(size)])
            phrases += [b" ".join([unique[c] for c in row]).decode() for row in zip(*(x.tolist() for x in own), strict=True)]
        return phrases

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data, told in zip(b.column("lang").to_pylist(), b.column("data"), b.column("parts"), strict=True):
                ok = np.concatenate([np.frombuffer(x["offsets"].as_buffer(), np.uint32).astype(np.uint64) | np.uint64(x["part"].as_py() << within) for x in told])
                ok.sort()
                f: dict[str, int] = {}
                for text in _slices(zstandard.decompress(data.as_buffer()), SLICE_BYTES):
                    phrases = passing(lang, text, ok)
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for i, p in enumerate(phrases):
                        automaton.add_word(f" {p} ", i)
                    automaton.make_automaton()
                    matches = np.bincount(np.fromiter((i for _, i in automaton.iter(text.decode())), np.int64), minlength=len(phrases))
                    for p, x in zip(phrases, matches.tolist(), strict=True):
                        f[p] = f.get(p, 0) + x
                sizes = np.fromiter((p.count(" ") + 1 for p in f), np.int32, len(f))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(sizes), pa.array(list(f), pa.string()), pa.array(list(f.values()), pa.int64())], names=["lang", "size", "phrase", "f"])

    scanned = found.select("block", "lang", "data").join(parts, "block").select("lang", "data", "parts").mapInArrow(scan, "lang string, size int, phrase string, f long")
    out = stored(scanned.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), release=True)
    n = stored(found.groupBy("lang").agg(F.sum("words").alias("n")))
    drop(parts._plumbline_told)
    drop(found)
    return out, n


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The different rows of integer columns, as columns."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [c[new] for c in columns]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first top phrases of 2 to LONGEST words.

    A null lang is `und` (and one with a lang of that name), null and empty texts have no
    words. Equal scores and counts are ranked by the phrase's bytes, so ranks have no ties;
    repeated rows count as often as they occur. An empty table, or one without a candidate,
    gives no rows. Columns other than lang and text are not read.
    """
    every, n = counts(docs, least)
    phrases = every.where("size > 1").withColumn("words", F.split("phrase", " ", -1))
    part = lambda begin, length: F.array_join(F.slice("words", begin, length), " ")
    f = every.select("lang", "phrase", "f")

    # The lower score of all cuts; products are decimals, so no digit is lost.
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words", "size")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast((cast({SCALE} as decimal(8, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)")
    lowest = cuts.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r", "a").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut")).select("lang", "phrase", "cut.*")

    # What a longer candidate holds contiguously: the phrases one to LONGEST - 2 words shorter.
    longer = phrases.where("size > 2").select("lang", F.col("f").alias("longer"), "words", "size")
    longer = longer.select("lang", "longer", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("width"))
    longer = longer.select("lang", "longer", "words", "width", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("at"))
    most = longer.select("lang", part(F.col("at"), F.col("width")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(most, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a").join(n, "lang")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt: Column = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # first each share's best, so that no task sorts a whole language
    kept = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("place") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

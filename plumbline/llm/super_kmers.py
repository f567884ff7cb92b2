"""Exact substring de-duplication by words: super-k-mers in minimiser buckets.

A word goes if a window of WINDOW words that covers it also starts in a document with a
smaller doc_id. Windows are compared where they meet:

1. A window's minimiser is the smallest hash among its pieces of GRAM words. Consecutive
   windows with one minimiser are a super-k-mer: their words, some 70, stand for about 20
   windows, or for any number in a text that repeats itself. A count over all documents
   finds the minimisers that only one document has; so are their windows, and they go no
   further.
2. Every other super-k-mer travels as one packed string to the bucket of its minimiser. Of
   equal strings that meet on the way only those with ever smaller ids travel on; later ones
   are known to be repeats. Buckets with very many strings are dealt into portions by content.
3. In a bucket equal strings are one, with their smallest id. The windows of the different
   ones are sorted by their words; equal windows are then neighbours and their count and
   smallest id can be read off. Nothing is decided by a hash here.
4. Portions of one bucket only: the windows that came first in their portion go by their
   128-bit hash to where those of the other portions are.

A text that equals the whole text of a smaller id is found by its SHA-256 and sends nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, prepare, slices, stored, whole_groups
from .suffix_dedup import LAST, _runs, merged

WINDOW, GRAM = 50, 16  # words
PORTION = 2048  # super-k-mers of a bucket that one portion is meant for
WORDS_AT_ONCE = 400_000  # whose windows are sorted together, on average


def words(text: str) -> list[bytes]:
    """Maximal runs of bytes other than space and the controls from tab to carriage return."""
    return text.encode().split()


def super_kmers(lists: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Of texts as words: text, minimiser, first and last window, for each super-k-mer in order."""
    size = np.array([len(x) for x in lists], np.int64)
    fits = np.maximum(size - WINDOW + 1, 0)
    if not fits.sum():
        return (np.zeros(0, np.int64),) * 4
    codes, unique = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    h = np.array([xxhash.xxh64_intdigest(w) for w in unique], np.uint64)[codes]
    m = np.uint64(0x9E3779B97F4A7C15)
    for half in (1, 2, 4, 8):  # GRAM is 16
        h = h[:-half] * m + h[half:]
        m = np.uint64(int(m) ** 2 & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    have, pieces = 1, WINDOW - GRAM + 1
    while have * 2 <= pieces:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < pieces:
        h = np.minimum(h[: have - pieces], h[pieces - have :])
    text = np.repeat(np.arange(len(lists)), fits)
    window = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    h = h[np.repeat(np.cumsum(size) - size, fits) + window].view(np.int64)
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
    return text[head], h[head], window[head], window[np.append(head[1:], len(h)) - 1]


def window_numbers(groups: np.ndarray, strings: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, string) of every window of the strings in order: windows of one group have equal numbers exactly if
    their words are equal. Sorted by rank doubling: pairs of ranks of half the length are sorted and ranked again."""
    size = np.array([len(x) for x in strings], np.int64)
    fits = size - WINDOW + 1
    rank = pd.factorize(np.array([w for x in strings for w in x], dtype=object))[0].astype(np.int64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]

    of = {1: rank}
    for half in (1, 2, 4, 8, 16):
        of[2 * half] = joined(of[half][:-half], of[half][half:])
    n = len(rank) - WINDOW + 1
    whole = joined(joined(of[32][:n], of[16][32 : 32 + n]), of[2][48 : 48 + n])  # WINDOW is 32 + 16 + 2
    string = np.repeat(np.arange(len(strings)), fits)
    start = np.repeat(np.cumsum(size) - size, fits) + np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    return joined(groups[string], whole[start]), string


def _documents(docs: DataFrame, *extra: str) -> DataFrame:
    """d (the id to order by), t (hash of the text) and text; rows with equal d and t are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*extra, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def spans(docs: DataFrame) -> DataFrame:
    """d, t, spans (sorted, overlapping array<struct<begin, end>> in words) of documents with removed words, as a stored
    table. Texts that equal one with a smaller id are not in it."""
    prepare(docs.sparkSession)
    rows = _documents(docs)
    firsts = rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("d", "t")).alias("of")).select("of.*")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, d, t = b.column(2).to_pylist(), b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in slices(texts):
                text, h, _, _ = super_kmers([words(x) for x in texts[lo:hi]])
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[new], d[lo:hi][text[new]], t[lo:hi][text[new]])], names=["h", "d", "t"])

    minimisers = stored(rows.select("d", "t", "text").mapInArrow(listed, "h long, d long, t long"))
    repeated = stored(minimisers.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", F.ceil(F.col("n") / PORTION).cast("int").alias("portions")), release=True)
    of_doc = minimisers.join(repeated, "h").groupBy("d", "t").agg(F.collect_set(F.struct("h", "portions")).alias("which")).join(firsts, ["d", "t"], "left_semi")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Super-k-mers of repeated minimisers (kind 0); spans of those that an earlier document met here has (kind 1)."""
        met: dict[bytes, int] = {}
        for b in batches:
            b = b.drop_duplicates(["d", "t"]).sort_values(["d", "t"], ignore_index=True)
            texts = b["text"].tolist()
            for lo, hi in slices(texts):
                lists = [words(x) for x in texts[lo:hi]]
                text, h, first, last = super_kmers(lists)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                found = []
                for k in range(hi - lo):
                    d, t, own = int(b["d"][lo + k]), int(b["t"][lo + k]), lists[k]
                    which = {w["h"]: w["portions"] for w in b["which"][lo + k]}
                    for j in range(cuts[k], cuts[k + 1]):
                        portions = which.get(int(h[j]))
                        if portions is None:
                            continue
                        begin, end = int(first[j]), int(last[j]) + WINDOW
                        string = b" ".join(own[begin:end])
                        digest = xxhash.xxh3_128_digest(string)
                        held = met.get(digest, d)
                        if held < d:
                            found.append((1, 0, 0, d, t, begin, end, None))
                            continue
                        if len(met) > 500_000:
                            met.clear()
                        met[digest] = d
                        found.append((0, int(h[j]), int.from_bytes(digest[:4], "big") % portions if portions > 1 else -1, d, t, begin, end, string))
                yield pd.DataFrame(found, columns=["kind", "h", "portion", "d", "t", "begin", "end", "string"])

    texts = rows.join(of_doc, ["d", "t"]).select("d", "t", "text", "which")
    sent = stored(texts.mapInPandas(packed, "kind int, h long, portion int, d long, t long, begin int, end int, string binary"), release=True)

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Spans of repeats (kind 1), and of portions the windows without an earlier one in theirs (kind 2)."""
        columns = ["kind", "d", "t", "begin", "end", "window"]
        for b in whole_groups(batches, ["h", "portion"]):
            h, portion, d, t, begin, end, string = (b[c].to_numpy() for c in ("h", "portion", "d", "t", "begin", "end", "string"))
            out: list[tuple] = []
            cuts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (portion[1:] != portion[:-1]))).tolist() + [len(h)]
            groups, least, strings, rows = [], [], [], []  # of different strings: group, smallest id, words, rows with that id

            def compared() -> None:
                if not strings:
                    return
                number, of = window_numbers(np.array(groups), strings)
                own, low = np.array(least)[of], np.full(number.max() + 1, LAST)
                np.minimum.at(low, number, own)
                again = low[number] < own
                at = 0
                for words_, places in zip(strings, rows, strict=True):
                    part = again[at : at + len(words_) - WINDOW + 1]
                    at += len(part)
                    runs = _runs(part)
                    for i in places:
                        out.extend((1, d[i], t[i], begin[i] + lo, begin[i] + hi + WINDOW, None) for lo, hi in runs)
                    if portion[places[0]] >= 0:
                        for k in np.flatnonzero(~part).tolist():
                            name = xxhash.xxh3_128_digest(b" ".join(words_[k : k + WINDOW]))
                            out.extend((2, d[i], t[i], begin[i] + k, begin[i] + k + WINDOW, name) for i in places)
                for x in (groups, least, strings, rows):
                    x.clear()

            size = 0
            for p, q in zip(cuts, cuts[1:], strict=False):
                seen: dict[bytes, list[int]] = {}
                for i in sorted(range(p, q), key=lambda i: d[i]):
                    same = seen.setdefault(string[i], [])
                    if not same or d[same[0]] == d[i]:
                        same.append(i)
                    else:
                        out.append((1, d[i], t[i], begin[i], end[i], None))
                if len(seen) > 1 or portion[p] >= 0:
                    for s, places in seen.items():
                        groups.append(p)
                        least.append(d[places[0]])
                        strings.append(s.split(b" "))
                        rows.append(places)
                        size += len(strings[-1])
                if size > WORDS_AT_ONCE:
                    compared()
                    size = 0
            compared()
            yield pd.DataFrame(out, columns=columns)

    keys = ["h", "portion"]
    todo = sent.where("kind = 0").drop("kind").repartition(*keys).sortWithinPartitions(*keys)
    sorted_ = stored(todo.mapInPandas(bucket, "kind int, d long, t long, begin int, end int, window binary"), release=True)
    first = sorted_.where("kind = 2").select("window", "d", "t", "begin", "end")
    earliest = stored(first.groupBy("window").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("window", "lo"))
    later = first.join(earliest, "window").where("lo < d").select("d", "t", "begin", "end")
    both = sent.where("kind = 1").select("d", "t", "begin", "end").unionByName(sorted_.where("kind = 1").select("d", "t", "begin", "end")).unionByName(later)
    found = stored(both.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")), release=True)
    for x in (minimisers, repeated, sent, sorted_, earliest):
        drop(x)
    return found


def _with_spans(docs: DataFrame, *extra: str) -> DataFrame:
    """extra, text, copy (equal to the text of a smaller id) and spans of every row."""
    found = spans(docs)
    rows = _documents(docs, *extra)
    same = rows.select("d", "t", F.sha2("text", 256).alias("digest"))
    several = stored(same.groupBy("digest").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("digest", "lo"))
    copies = same.join(several, "digest").where("d <> lo").select("d", "t").distinct()
    marks = found.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    marks = marks.groupBy("d", "t").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("copy").alias("copy"))
    return rows.join(stored(marks), ["d", "t"], "left").select(*extra, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")


def _kept(own: list[bytes], copy: bool, found: list | None) -> list[bytes]:
    runs = [(0, len(own))] if copy and len(own) >= WINDOW else merged(found)
    if not runs:
        return own
    begins, ends = [0, *[q for _, q in runs]], [*[p for p, _ in runs], len(own)]
    return [w for p, q in zip(begins, ends, strict=True) for w in own[p:q]]


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    Null texts have no words; texts of fewer than WINDOW words keep everything. A null doc_id
    comes after all others. Rows with one id (or all without) are no repeats of each other,
    whatever their texts; each has its own row in the result. Columns other than doc_id and
    text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, copy, found in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                own = words(text)
                kept = _kept(own, copy, found)
                out.append((len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated words taken out of text; the text of a row that loses any is its kept words, joined
    by one space. Other columns stay as they are."""
    names = docs.columns
    own = docs.select(F.struct(*[n for n in names if n != "text"]).alias("row"), "doc_id", "text", F.col("text").isNull().alias("null"))
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for text, copy, found, null in zip(b["text"], b["copy"], b["spans"], b["null"], strict=True):
                every = words(text)
                kept = _kept(every, copy, found)
                texts.append(None if null else text if len(kept) == len(every) else b" ".join(kept).decode())
            yield pd.DataFrame({"row": b["row"], "kept": texts})

    found = _with_spans(own, "row", "null")
    kept = found.mapInPandas(run, f"row {found.schema['row'].dataType.simpleString()}, kept string")
    return kept.select(*[F.col("kept").alias("text") if n == "text" else F.col("row")[n].alias(n) for n in names])

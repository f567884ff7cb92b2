"""Exact substring de-duplication of a corpus by suffix arrays.

A byte goes if a WIDTH-byte string that covers it also starts earlier: in a document with a
smaller doc_id, or further left in the same one. Equality of strings is decided by suffix
arrays (gsaca.py); the rest brings together what may be equal, in bounded portions:

1. Every WIDTH-byte string has an anchor, the GRAM-byte piece in it with the smallest hash
   (the leftmost of equals). Equal strings have equal anchors, and neighbouring strings
   mostly share theirs, so there is one anchor for each 35 bytes or so. Anchors that occur
   once in all texts belong to strings that occur once; a count over all anchors finds them.
2. A repeated anchor of a document stands for the strings around it, its context. Contexts
   with equal anchors go to one task. Where an anchor is too frequent for that, they are
   dealt into portions by content, so equal contexts stay together.
3. Of equal contexts the earliest stays. The different ones are laid side by side and
   sorted; equal strings are then neighbours, and all but the earliest are repeats.
4. Frequent anchors only: the earliest string of each portion goes by its 128-bit hash to
   where those of the other portions are, and all but the earliest of them are repeats.

Exact copies of a document are found by their digest and only add one step to this.
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
from .gsaca import suffix_arrays

WIDTH, GRAM = 100, 32
PORTION = 2048  # contexts of an anchor that one portion is meant for
SYMBOLS = 2_000_000  # bytes sorted side by side
PIECE = 50_000  # bytes hashed at a time, so that the arrays on the way stay in a processor's cache
LAST = (1 << 63) - 1  # stands for a null doc_id, after all others


def anchors(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, hash, first and last start of the strings, for each anchor in order. Texts are
    looked at in pieces that fit a processor's cache (a longer text stands alone)."""
    ends, begin, parts = np.append(0, np.cumsum(size)), 0, [_anchors(data[:0], size[:0])]
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PIECE, side="right")) - 1)
        text, *rest = _anchors(data[ends[begin] : ends[end]], size[begin:end])
        parts.append((text + begin, *rest))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchors() of one piece."""
    n, windows = len(data), WIDTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none
    h = data.astype(np.uint64) + np.uint64(1)
    m = np.uint64(0x9E3779B97F4A7C15)
    for half in (1, 2, 4, 8, 16):  # GRAM is 32
        h = h[:-half] * m + h[half:]
        m = np.uint64(int(m) ** 2 & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    low, have = v, 1
    while have * 2 <= windows:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < windows:
        low = np.minimum(low[: len(v) - windows + 1], low[windows - have :])
    ends = np.cumsum(size)
    fits = np.maximum(size - WIDTH + 1, 0)
    start = np.repeat(ends - size - (np.cumsum(fits) - fits), fits) + np.arange(fits.sum())
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else none
    text = np.searchsorted(ends, start[change], side="right")
    first = start[change]
    last = start[np.append(change[1:], len(at)) - 1] if len(at) else none
    return text, h[at[change]].view(np.int64), first - (ends - size)[text], last - (ends - size)[text]


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def _string_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the WIDTH bytes from each place on, in pieces."""
    out = np.empty(max(0, len(data) - WIDTH + 1), np.uint64)
    for lo in range(0, len(out), PIECE):
        out[lo : lo + PIECE] = _hashes(data[lo : lo + PIECE + WIDTH - 1])
    return out


def _hashes(data: np.ndarray) -> np.ndarray:
    """_string_hashes() of one piece (WIDTH is 64 + 32 + 4)."""
    h, m, of = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, {}
    for half in (1, 2, 4, 8, 16, 32):
        h = h[:-half] * np.uint64(m) + h[half:]
        h ^= h >> np.uint64(31)
        m = m * m & 0xFFFFFFFFFFFFFFFF
        of[2 * half] = h
    n = len(data) - WIDTH + 1
    return (of[64][:n] * np.uint64(m) + of[32][64 : 64 + n]) * np.uint64(0xD6E8FEB86659FD93) + of[4][96 : 96 + n]


def repeats(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    """Of contexts in order, by group: for each start of a string, the number of its first equal in the group.

    The starts of a group's contexts are numbered one after another; those numbers are the
    result too, so a start whose entry is its own number is no repeat. Strings whose hash
    occurs once in their group have no equal, so contexts are sorted only from the first to
    the last string that may have one.
    """
    lens = np.array([len(c) for g in groups for c in g], np.int64)
    fits = np.maximum(lens - WIDTH + 1, 0)
    of_group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    first_number = np.cumsum(fits) - fits
    per_group = np.array([0, *np.cumsum(np.bincount(of_group, fits, len(groups)).astype(np.int64))])
    whole = [[np.arange(n, n + f) for n, f in zip(a, b, strict=True)] for a, b in zip(*(np.split(x, np.cumsum([len(g) for g in groups])[:-1]) for x in (first_number - per_group[of_group], fits)), strict=True)] if groups else []
    if not fits.sum():
        return whole
    ends = np.cumsum(lens)
    start = np.repeat(ends - lens - first_number, fits) + np.arange(fits.sum())
    context = np.repeat(np.arange(len(lens)), fits)
    key = _string_hashes(np.frombuffer(b"".join(c for g in groups for c in g), np.uint8))[start] * np.uint64(0xBF58476D1CE4E5B9) + of_group[context].astype(np.uint64)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    hits = np.flatnonzero(times[inverse] > 1)
    lo, hi = np.full(len(lens), -1), np.full(len(lens), -2)
    hi[context[hits]] = hits - first_number[context[hits]]
    back = hits[::-1]
    lo[context[back]] = back - first_number[context[back]]
    parts: list[list[bytes]] = [[] for _ in groups]
    which: list[list[int]] = [[] for _ in groups]
    at = 0
    for g, contexts in enumerate(groups):
        for k, c in enumerate(contexts):
            if lo[at] >= 0:
                parts[g].append(c[lo[at] : hi[at] + WIDTH])
                which[g].append(k)
            at += 1
    begin = np.cumsum([0, *[len(g) for g in groups]])
    some = [g for g, p in enumerate(parts) if p]
    for g, found in zip(some, _sorted_repeats([parts[g] for g in some]), strict=True):
        number = np.concatenate([whole[g][k][lo[begin[g] + k] : hi[begin[g] + k] + 1] for k in which[g]])
        for k, f in zip(which[g], found, strict=True):
            whole[g][k] = whole[g][k].copy()
            whole[g][k][lo[begin[g] + k] : hi[begin[g] + k] + 1] = number[f]
    return whole


def _sorted_repeats(groups: list[list[bytes]]) -> list[list[np.ndarray]]:
    """repeats() by suffix arrays."""
    out: list[list[np.ndarray]] = [[] for _ in groups]
    sizes = [sum(map(len, g)) + len(g) for g in groups]
    order = sorted(range(len(groups)), key=sizes.__getitem__)[::-1]
    while order:
        batch = [order.pop()]
        symbols = sizes[batch[0]]
        while order and symbols + sizes[order[-1]] <= SYMBOLS:
            batch.append(order.pop())
            symbols += sizes[batch[-1]]
        parts, size, begins, starts, lens = [], [], [], [], []
        at = 0
        for g in batch:
            begins.append(at)
            for c in groups[g]:
                parts.append(c)
                starts.append(at)
                lens.append(len(c))
                at += len(c) + 1
            size.append(at - begins[-1])
        text = np.ones(at, np.int64)  # 1 ends a context, 0 ends a group; bytes come after
        raw = np.zeros(at + WIDTH, np.uint8)
        starts_, lens_ = np.array(starts), np.array(lens)
        where = np.repeat(starts_ - (np.cumsum(lens_) - lens_), lens_) + np.arange(lens_.sum())
        raw[where] = np.frombuffer(b"".join(parts), np.uint8)
        text[where] = raw[where].astype(np.int64) + 2
        text[np.array(begins) + np.array(size) - 1] = 0
        number = np.full(at, -1, np.int64)  # of the string that starts there
        valid = np.maximum(lens_ - WIDTH + 1, 0)
        number[np.repeat(starts_ - (np.cumsum(valid) - valid), valid) + np.arange(valid.sum())] = np.arange(valid.sum())
        sa = suffix_arrays(text, np.array(size))
        sa = sa[number[sa] >= 0]
        group = np.searchsorted(np.array(begins), sa, side="right")
        same = np.append(False, group[1:] == group[:-1])
        look = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
        near = np.flatnonzero(same)
        for lo in range(0, len(near), 50_000):
            i = near[lo : lo + 50_000]
            same[i] = (look[sa[i]] == look[sa[i - 1]]).all(axis=1)
        heads = np.flatnonzero(~same)
        first = np.empty(len(sa), np.int64)
        if len(sa):
            nums = number[sa]
            first[nums] = np.repeat(np.minimum.reduceat(nums, heads), np.diff(np.append(heads, len(sa))))
        done = 0
        ends = np.cumsum(valid)
        k = 0
        for g in batch:
            here = len(groups[g])
            base = done
            out[g] = [first[ends[j] - valid[j] : ends[j]] - base for j in range(k, k + here)]
            k += here
            done = int(ends[k - 1]) if here else done
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each run of true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _documents(docs: DataFrame, *extra: str) -> DataFrame:
    """d (the id to order by), t (hash of the text), u (of both) and text; rows with equal d and t are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*extra, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.withColumn("u", F.xxhash64("d", "t"))


def spans(docs: DataFrame) -> DataFrame:
    """d, t, spans (sorted, overlapping array<struct<begin, end>>) of documents with removed bytes, as a stored table."""
    prepare(docs.sparkSession)
    rows = _documents(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An anchor's smallest and largest text, and whether one text has it twice."""
        for b in batches:
            texts, t = [x.encode() for x in b.column(1).to_pylist()], b.column(0).to_numpy()
            for lo, hi in slices(texts):
                text, h, _, _ = anchors(*_flat(texts[lo:hi]))
                if not len(h):
                    continue
                of = t[lo:hi][text]
                order = np.lexsort((text, of, h))
                h, of, text = h[order], of[order], text[order]
                head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                twice = np.append(False, (h[1:] == h[:-1]) & (text[1:] == text[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[head], of[head], of[np.append(head[1:], len(h)) - 1], np.maximum.reduceat(twice.astype(np.int8), head) > 0, np.diff(np.append(head, len(h))))], names=["h", "lo", "hi", "twice", "n"])

    counted = rows.select("t", "text").mapInArrow(count, "h long, lo long, hi long, twice boolean, n long")
    counted = counted.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("twice").alias("twice"), F.sum("n").alias("n"))
    repeated = stored(counted.where("lo <> hi or twice").select("h", F.ceil(F.col("n") / PORTION).cast("int").alias("portions")), release=True)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, u = [x.encode() for x in b.column(1).to_pylist()], b.column(0).to_numpy()
            for lo, hi in slices(texts):
                text, h, _, _ = anchors(*_flat(texts[lo:hi]))
                nth = np.arange(len(text)) - np.searchsorted(text, text)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, u[lo:hi][text], nth.astype(np.int32))], names=["h", "u", "nth"])

    firsts = stored(rows.groupBy("t", F.sha2("text", 256).alias("digest")).agg(F.min("d").alias("d")))
    originals = firsts.select(F.xxhash64("d", "t").alias("u"))
    of_doc = rows.select("u", "text").mapInArrow(listed, "h long, u long, nth int").join(repeated, "h")
    of_doc = of_doc.groupBy("u").agg(F.collect_list(F.struct("nth", "portions")).alias("which")).join(originals, "u", "left_semi")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Contexts of repeated anchors; of equal ones met here only those that come before all earlier met."""
        met: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for b in batches:
            b = b.drop_duplicates(["d", "t"]).sort_values(["d", "t"], ignore_index=True)
            texts = [x.encode() for x in b["text"]]
            for lo, hi in slices(texts):
                text, h, first, last = anchors(*_flat(texts[lo:hi]))
                begin = np.searchsorted(text, np.arange(hi - lo))
                found = []
                for k in range(hi - lo):
                    d, t, data = int(b["d"][lo + k]), int(b["t"][lo + k]), texts[lo + k]
                    for nth, portions in sorted({(w["nth"], w["portions"]) for w in b["which"][lo + k]}):
                        j = begin[k] + nth
                        a = int(first[j])
                        context = data[a : int(last[j]) + WIDTH]
                        key, place = (int(h[j]), xxhash.xxh3_128_digest(context)), (d, t, a)
                        held = met.get(key)
                        if held is not None and held < place:
                            found.append((1, 0, 0, d, t, a, a + len(context), None))
                            continue
                        if len(met) > 500_000:
                            met.clear()
                        met[key] = place
                        found.append((0, key[0], int.from_bytes(key[1][:4], "big") % portions if portions > 1 else -1, d, t, a, 0, context))
                yield pd.DataFrame(found, columns=["kind", "h", "portion", "d", "t", "begin", "end", "context"])

    table = rows.select("u", "d", "t", "text").join(of_doc, "u").select("d", "t", "text", "which")
    met = stored(table.mapInPandas(contexts, "kind int, h long, portion int, d long, t long, begin int, end int, context binary"), release=True)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, ["h", "portion"], 10_000):
            h, portion, d, t, begin, context = (b[c].to_numpy() for c in ("h", "portion", "d", "t", "begin", "context"))
            out, groups, owners = [], [], []
            cuts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (portion[1:] != portion[:-1]))).tolist() + [len(h)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                seen: dict[bytes, int] = {}
                for i in sorted(range(p, q), key=lambda i: (d[i], t[i], begin[i])):
                    j = seen.setdefault(context[i], i)
                    if (d[i], t[i], begin[i]) != (d[j], t[j], begin[j]):  # not a repeated row
                        out.append((1, d[i], t[i], begin[i], begin[i] + len(context[i]), None))
                if len(seen) > 1 or portion[p] >= 0 or len(context[p]) > 2 * WIDTH:
                    groups.append(list(seen))
                    owners.append(list(seen.values()))
            for contexts, own, firsts in zip(groups, owners, repeats(groups), strict=True):
                at = 0
                for c, i, first in zip(contexts, own, firsts, strict=True):
                    again = first != np.arange(at, at + len(first))
                    at += len(first)
                    out += [(1, d[i], t[i], begin[i] + lo, begin[i] + hi + WIDTH, None) for lo, hi in _runs(again)]
                    if portion[i] >= 0:
                        out += [(2, d[i], t[i], begin[i] + k, 0, xxhash.xxh3_128_digest(c[k : k + WIDTH])) for k in np.flatnonzero(~again).tolist()]
            yield pd.DataFrame(out, columns=["kind", "d", "t", "begin", "end", "string"])

    keys = ["h", "portion"]
    todo = met.where("kind = 0").select("h", "portion", "d", "t", "begin", "context").repartition(*keys).sortWithinPartitions(*keys)
    sorted_ = stored(todo.mapInPandas(sort, "kind int, d long, t long, begin int, end int, string binary"), release=True)
    # Strings of frequent anchors: the earliest of each portion, compared over the portions.
    place = F.struct("d", "t", "begin")
    shared = sorted_.where("kind = 2").select("string", "d", "t", "begin")
    earliest = stored(shared.groupBy("string").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = shared.join(earliest, "string").where(place != F.col("first")).select("d", "t", "begin", (F.col("begin") + WIDTH).alias("end"))
    both = met.where("kind = 1").select("d", "t", "begin", "end").unionByName(sorted_.where("kind = 1").select("d", "t", "begin", "end")).unionByName(later)
    found = stored(both.groupBy("d", "t").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")), release=True)
    for t in (repeated, firsts, met, sorted_, earliest):
        drop(t)
    return found


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs; those that touch are one."""
    out: list[list[int]] = []
    for s in spans if spans is not None else ():
        if out and s["begin"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["begin"], s["end"]])
    return [(p, q) for p, q in out]


def _with_spans(docs: DataFrame, *extra: str) -> DataFrame:
    """extra, text, copy (an exact copy of an earlier document) and spans of every row."""
    found = spans(docs)
    rows = _documents(docs, *extra)
    by_text = stored(_documents(docs).groupBy("t", F.sha2("text", 256).alias("digest")).agg(F.min("d").alias("first"), F.count_distinct("d").alias("n")).where("n > 1").select("t", "digest", "first"))
    copies = stored(_documents(docs).select("d", "t", F.sha2("text", 256).alias("digest")).join(by_text, ["t", "digest"]).where("d <> first").select("d", "t").distinct())
    marks = found.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    marks = marks.groupBy("d", "t").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("copy").alias("copy"))
    return rows.join(stored(marks), ["d", "t"], "left").select(*extra, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")


def _cut(data: bytes, copy: bool, found: list | None) -> tuple[list[tuple[int, int]], bytes]:
    runs = [(0, len(data))] if copy and len(data) >= WIDTH else merged(found)
    if not runs:
        return runs, data
    begins, ends = [0, *[q for _, q in runs]], [*[p for p, _ in runs], len(data)]
    return runs, b"".join([data[p:q] for p, q in zip(begins, ends, strict=True)])


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Null texts are empty; texts under WIDTH bytes keep everything. A null doc_id comes after
    all others, and documents with equal ids are ordered by a hash of their texts. Rows that
    repeat an id with its text are one document: they get the same result and are no
    repeats of each other. Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, copy, found in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                runs, kept = _cut(data, copy, found)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeats taken out of text (a character that loses a byte goes); n_chars follows if it is there."""
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), "doc_id", "text")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if null else _cut(x.encode(), c, s)[1].decode("utf-8", "ignore") for x, c, s, null in zip(b["text"], b["copy"], b["spans"], b["null"], strict=True)]
            yield pd.DataFrame({"row": b["row"], "kept": texts})

    rest = [n for n in names if n != "text"]
    slim = F.struct(*[F.col("row")[n].alias(n) for n in rest])
    found = _with_spans(own, "row").select(slim.alias("row"), F.col("row")["text"].isNull().alias("null"), "text", "copy", "spans")
    kept = found.mapInPandas(run, _field(found, "row") + ", kept string")
    chars = {"n_chars": F.coalesce(F.length("kept"), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {}
    return kept.select(*[F.col("kept").alias("text") if n == "text" else chars[n].alias(n) if n in chars else F.col("row")[n].alias(n) for n in names])


def _field(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"

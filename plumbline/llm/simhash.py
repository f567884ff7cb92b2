"""SimHash near-duplicates over a Gray-order hierarchical index.

The 64 bits are cut into DISTANCE + r bands. Fingerprints that differ in at most DISTANCE
bits agree on some r of them, so a group (r bands, their bits) holds all candidates for its
members and groups are independent tasks; r is the least with which a group of random
fingerprints fits a block, so a row's copies do not grow with the table. In a group the fingerprints are sorted by Gray rank, which puts those
with few differences side by side. Every FAN neighbours get an upper node that holds the
bits they all share (mask and pattern), less what the nodes above hold already. A search
goes down from the top, adds up the differences in the masked bits and drops a whole node
once they exceed DISTANCE.

Equal fingerprints are one class and searched once. A group larger than BLOCK is dealt
into blocks, and every pair of its blocks is a task, so no task grows with a group. A task
returns a spanning forest of the links it found, not the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, whole_groups
from .components import components, roots

WORDS, SEED = 4, 42
DISTANCE = 4
BLOCK, FAN = 512, 8
QUERIES_AT_ONCE = 2048
PIECE = 1 << 20
SALTS = 32


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that are cut at white space."""
    at = 0
    while len(data) - at > 2 * PIECE:
        end = data.rfind(b" ", at, at + PIECE) + 1
        if end <= at:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of every run of WORDS words of the text, A-Z lower-cased (fewer words: of all of them)."""
    if not text:
        return np.zeros(0, np.uint64)
    carry: list[bytes] = []
    out, digest = [], xxhash.xxh64_intdigest
    for piece in _pieces(text.encode().lower()):
        words = carry + piece.split()
        if len(words) < WORDS:
            carry = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begin = np.concatenate([[0], ends[:-WORDS]]).tolist()
        out.append(np.array([digest(line[p:q], SEED) for p, q in zip(begin, (ends[WORDS - 1 :] - 1).tolist(), strict=True)], np.uint64))
        carry = words[-(WORDS - 1) :]
    if not out and carry:
        out = [np.array([digest(b" ".join(carry), SEED)], np.uint64)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Bit i is 1 if over half of a text's hashes have it; texts without a word get 0."""
    result = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        h = shingle_hashes(t)
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            result[i] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return result


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row's whole text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1).to_pylist()).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """One hierarchy over the fingerprints of many groups; groups share no node."""

    def __init__(self, group: np.ndarray, fp: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[self.order], group[self.order]
        self.fp = fp
        _, self.group = np.unique(group, return_inverse=True)
        # Levels from the leaves up; of a node: AND and OR of its fingerprints, first and end child.
        owner, both, some = self.group, fp, fp
        levels = [(fp, np.full(len(fp), ~np.uint64(0)), None, None)]
        while True:
            counts = np.bincount(owner)
            begin = np.cumsum(counts) - counts
            if (counts <= 1).all() and len(levels) > 1:
                break
            first = np.flatnonzero((np.arange(len(owner)) - begin[owner]) % FAN == 0)
            both, some = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(some, first)
            levels.append((both, ~(both ^ some), first, np.append(first[1:], len(owner))))
            owner = owner[first]
        self.levels = levels[::-1]

    def pairs(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (i, j), places in the sorted order, of all pairs of a group within the distance."""
        for at in range(0, len(self.fp), QUERIES_AT_ONCE):
            q = np.arange(at, min(at + QUERIES_AT_ONCE, len(self.fp)))
            node = self.group[q]  # the top level has one node for each group
            above = np.zeros(len(q), np.uint64)
            diff = np.zeros(len(q), np.int64)
            for depth, (pattern, mask, first, end) in enumerate(self.levels):
                # What the nodes above share is counted already.
                diff = diff + np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node] & ~above)
                near = diff <= distance
                q, node, diff, above = q[near], node[near], diff[near], mask[node[near]]
                if depth + 1 < len(self.levels):
                    n = end[node] - first[node]
                    q, diff, above = np.repeat(q, n), np.repeat(diff, n), np.repeat(above, n)
                    node = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            later = node > q
            yield q[later], node[later]


def masks(count: int) -> list[int]:
    """The bits of each choice of r out of DISTANCE + r bands, for a table of count distinct fingerprints."""
    for r in (1, 2, 3, 4):
        n = DISTANCE + r
        ends = [64 * i // n for i in range(n + 1)]
        bands = [((1 << (q - p)) - 1) << p for p, q in zip(ends, ends[1:], strict=False)]
        chosen = [sum(c) for c in itertools.combinations(bands, r)]
        if count >> min(m.bit_count() for m in chosen) <= BLOCK:
            break
    return chosen


def links(classes: DataFrame) -> DataFrame:
    """classes(fp, rep) with distinct fp -> links (a, b) between reps, a spanning forest of each task's."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks(classes.count()))]))
    rows = classes.select("fp", "rep", band.alias("k")).select("fp", "rep", "k.band", "k.bits")
    large = stored(rows.groupBy("band", "bits").count().where(F.col("count") > BLOCK).select("band", "bits", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(large, ["band", "bits"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("fp", "rep", "band", "bits", blocks.alias("blocks"), own.alias("own")).select("fp", "rep", "band", "bits", "own", other.alias("other"))
    keys = ["band", "bits", "lo", "hi"]
    rows = rows.select("fp", "rep", "band", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            group = (b[keys] != b[keys].shift()).any(axis=1).cumsum().to_numpy()
            size = np.bincount(group)[group]
            b, group = b[size > 1], group[size > 1]
            if not len(b):
                continue
            index = GrayIndex(group, b["fp"].to_numpy().view(np.uint64))
            root = np.arange(len(b))
            for i, j in index.pairs():
                root = roots(len(b), i, j, root)
            rep = b["rep"].to_numpy()[index.order]
            child = np.flatnonzero(root != np.arange(len(b)))
            yield pd.DataFrame({"a": rep[child], "b": rep[root[child]]})

    kind = classes.schema["rep"].dataType.simpleString()
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(search, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row's whole text.

    Texts that are null or have no word have fingerprint zero and link like others. Rows
    with a null doc_id link too and get the smallest id of their component, null if only
    such rows are in it; repeated rows are one document and come out as often. Columns
    other than doc_id and text are not read.
    """
    fps = stored(fingerprints(docs))
    rows = fps.count()
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), rows=rows)
    found = components(links(classes.select("fp", F.col("fp").alias("rep"))))
    held = stored(classes.join(found, classes.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), rows=rows)
    # A component's smallest id goes back to its classes in SALTS copies, so that a large component is not one task's.
    least = held.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select("component", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = held.withColumn("salt", F.pmod("fp", F.lit(SALTS)).cast("int")).join(least, ["component", "salt"], "left")
    named = stored(held.select("fp", F.coalesce("least", "rep").alias("component_id")), rows=rows)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs of every component of fingerprints: the smallest by doc_id (null last), fingerprint and text hash.

    Components are those of the texts alone, so different texts under one doc_id, or under
    none, each keep a row. Rows equal in doc_id and text are one.
    """
    text = F.col("text").cast("string")
    hashes = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array(fingerprints_of(b.column(3).to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fps, b.column(1), b.column(2)], names=["doc_id", "fp", "h1", "h2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", hashes[0].alias("h1"), hashes[1].alias("h2"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, fp long, h1 long, h2 long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "h1", "h2")).alias("first")
    classes = stored(rows.groupBy("fp").agg(first))
    found = components(links(classes.select("fp", F.col("fp").alias("rep"))))
    named = classes.join(found, classes.fp == found.node, "left").select(F.coalesce("component", "fp").alias("component"), "first")
    keep = stored(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), "first.h1", "first.h2"))
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), hashes[0].alias("own_h1"), hashes[1].alias("own_h2"))
    out = d.join(keep, (F.col("own_h1") == F.col("h1")) & (F.col("own_h2") == F.col("h2")) & F.col("own_id").eqNullSafe(F.col("kept_id")))
    return out.dropDuplicates(["own_h1", "own_h2", "own_id"]).select("row.*")

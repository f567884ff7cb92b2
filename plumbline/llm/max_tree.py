"""Ranked lexical search: trees of maxima over document ranges, one for each term, searched best first.

index() turns runs of up to SHARD_DOCS rows into shards, a row of the stored index each, in
which documents with like words stand side by side. A tree has the shard's documents as
leaves; a node stands for FAN neighbours and has, for each term, the largest of their values.
The sum of a node's maxima over a query's terms is at least the score of each document below.

A search keeps the open nodes in a heap, largest sum first. An inner node is replaced by its
children, a leaf's sum is its document's exact score. When k leaves have come out, only nodes
whose sum equals the k-th score are still opened, for the ties. Scores are whole numbers, so
nothing depends on the order of sums.

Counts (documents, terms, documents of a term) are taken over all shards. Queries are dealt
into blocks; a task pairs a shard with a block, both read where they lie. A query's k-th best
score is carried from shard to shard in a task and between levels of shards, each eight times
as large as all before it, so what a query brings out of a level does not grow with the corpus.
The levels' best are merged by score, then smaller doc_id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bm25 import _neighbours, _terms
from .common import drop, prepare, stored

K = 20
FAN = 8
SHARD_DOCS, SHARD_BYTES = 4096, 8_000_000
BLOCK_QUERIES = 256  # of a task, on average
TERMS_AT_ONCE = 2048  # with trees in memory at a time
WANTED = 1 << 16  # terms whose documents are counted at a time, on average
FACTOR = 8  # between levels of shards

#: ASCII letters and digits are kept, A-Z in lower case; all other ASCII characters part terms.
TABLE = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
PACKED = ["terms", "ends", "docs", "tf", "lens", "ids", "valid"]
TYPES = ["<i8", "<i8", "<u2", "<u4", "<i8", "<i8", "?"]


def words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def index(docs: DataFrame) -> DataFrame:
    """A stored row for each shard: shard, filled (documents with a term), words, and packed arrays: terms (hashes),
    ends of their postings, docs and counts of the postings, lens, ids and valid (false: no id) of its documents."""
    prepare(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # the same again if the task is run again
        ids: list = []
        texts: list = []
        size = 0

        def shard() -> pa.RecordBatch:
            text, term, count, lens = _terms(texts, words)
            head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            df = np.diff(np.append(head, len(term)))
            place = _neighbours(text, count, df, len(texts))
            order = np.argsort(place)
            new = np.lexsort((place[text], np.repeat(np.arange(len(df)), df)))
            arrays = [term[head], np.cumsum(df), place[text][new], count[new], lens[order], [ids[i] or 0 for i in order], [ids[i] is not None for i in order]]
            values = [pa.array([v]) for v in (number, int((lens > 0).sum()), int(lens.sum()))]
            packed = [pa.array([np.asarray(x).astype(t).tobytes()], pa.binary()) for x, t in zip(arrays, TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(values + packed, names=["shard", "filled", "words", *PACKED])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(build, "shard long, filled long, words long, " + ", ".join(f"{c} binary" for c in PACKED)))


def document_counts(terms: DataFrame, shards: DataFrame) -> DataFrame:
    """term, df for every term of terms(term) that occurs: blocks of wanted terms against the shards' lists of terms."""
    wanted = terms.select("term").distinct()
    parts = max(1, -(-wanted.count() // WANTED))
    blocks = stored(wanted.groupBy(F.pmod(F.xxhash64("term", F.lit("part")), F.lit(parts)).alias("part")).agg(F.collect_list("term").alias("wanted")))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, ends, asked in zip(*(b.column(c) for c in ("terms", "ends", "wanted")), strict=True):
                own, ends = np.frombuffer(own.as_buffer(), "<i8"), np.frombuffer(ends.as_buffer(), "<i8")
                asked = asked.values.to_numpy()
                if len(own):
                    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                    has = own[at] == asked
                    yield pa.RecordBatch.from_arrays([pa.array(asked[has]), pa.array(np.diff(ends, prepend=0)[at[has]])], names=["term", "df"])

    return shards.select("terms", "ends").join(blocks.select("wanted").hint("shuffle_replicate_nl")).mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_blocks(items: DataFrame, shards: DataFrame, rows: int) -> DataFrame:
    """A row for each block of queries: block and packed arrays of item_ids, sizes, terms and weights (by term)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, term, count, _ = _terms(b["text"].tolist(), words)
            yield pd.DataFrame({"query": b["query"].to_numpy()[text], "item_id": b["item_id"].to_numpy()[text], "term": term, "times": count.astype(np.int64)})

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["query", "item_id", "term"])
        head = (g[["query", "item_id"]] != g[["query", "item_id"]].shift()).any(axis=1).to_numpy()
        sizes = np.diff(np.append(np.flatnonzero(head), len(g)))
        weights = np.floor(1000 * np.log((2.0 * rows + 2) / (2.0 * g["df"].to_numpy() + 1))).astype(np.int64) * g["times"].to_numpy()
        packed = [g["item_id"].to_numpy()[head], sizes, g["term"].to_numpy(), weights]
        return pd.DataFrame([[int(g["block"].iloc[0]), *(np.asarray(x).astype("<i8").tobytes() for x in packed)]], columns=["block", "item_ids", "sizes", "q_terms", "weights"])

    text = F.col("text").cast("string")
    asked = items.where("item_id is not null").select(F.xxhash64("item_id", text).alias("query"), F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    terms = stored(asked.mapInPandas(split, "query long, item_id long, term long, times long"))
    block = F.pmod(F.xxhash64("query", "item_id", F.lit("block")), F.lit(blocks)).cast("int")
    known = terms.join(document_counts(terms, shards), "term").select(block.alias("block"), "query", "item_id", "term", "times", "df")
    return stored(known.groupBy("block").applyInPandas(pack, "block int, item_ids binary, sizes binary, q_terms binary, weights binary"))


class Trees:
    """The trees of some terms (sorted hashes) over a shard's documents: a matrix (term, node) for each level, leaves first."""

    def __init__(self, wanted: np.ndarray, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, tf: np.ndarray, lens: np.ndarray, rows: int, total: int) -> None:
        at = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
        has = terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)
        self.row = np.where(has, np.cumsum(has) - 1, -1)  # of each wanted term
        begins, ends = np.append(0, ends[:-1])[at[has]] if has.any() else np.zeros(0, np.int64), ends[at[has]] if has.any() else np.zeros(0, np.int64)
        n = ends - begins
        place = np.arange(n.sum()) + np.repeat(begins - (np.cumsum(n) - n), n)
        m = 100 - 25 + (25 * lens * rows) // max(1, total)
        tf, docs = tf[place].astype(np.int64), docs[place]
        leaves = np.zeros((len(n), len(lens)), np.int32)  # values are below a million
        leaves[np.repeat(np.arange(len(n)), n), docs] = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
        self.levels = [leaves]
        while self.levels[-1].shape[1] > FAN:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int) -> list[tuple[int, int]]:
        """(score, document), highest first: the k best, all that equal the last of them, none under floor or 0.
        terms are places among the wanted terms."""
        row = self.row[terms]
        weights, row = weights[row >= 0], row[row >= 0]
        if not len(row):
            return []
        low, top, found = max(floor, 1), len(self.levels) - 1, []
        heap: list[tuple[int, int, int]] = []

        def opened(level: int, begin: int, end: int) -> None:
            for node, bound in enumerate((weights @ self.levels[level][row, begin:end]).tolist(), begin):
                if bound >= low:
                    heapq.heappush(heap, (-bound, level, node))

        opened(top, 0, FAN)
        while heap and -heap[0][0] >= low:
            bound, level, node = heapq.heappop(heap)
            if level:
                opened(level - 1, node * FAN, node * FAN + FAN)
                continue
            found.append((-bound, node))
            if len(found) == k:
                low = max(low, -bound)
        return found


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring rows of docs for each row of items(item_id, text).

    Null texts and texts without a term match nothing and count as no document; items without
    a term that occurs have no rows. Items without an id are skipped, an item repeated with its
    text is one, an id with two texts has two lists. Documents without an id are found and come
    last of equals; repeated rows are found as often as they occur. Other columns are not read.
    """
    shards = index(docs)
    n, rows, total = shards.agg(F.count("*"), F.sum("filled"), F.sum("words")).first()  # one row
    rows, total = rows or 0, total or 0
    blocks = query_blocks(items, shards, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        columns, types = [*PACKED, "item_ids", "sizes", "q_terms", "weights"], [*TYPES, "<i8", "<i8", "<i8", "<i8"]
        for b in batches:
            for i in range(b.num_rows):
                block, known = b.column("block")[i].as_py(), b.column("floors")[i].as_py()
                terms, ends, of, tf, lens, ids, valid, item_ids, sizes, q_terms, weights = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(columns, types, strict=True))
                if block not in floors:
                    floors[block] = np.zeros(len(sizes), np.int64)
                    for f in known or []:
                        floors[block][f["query"]] = f["low"]
                floor, cuts, out = floors[block], np.append(0, np.cumsum(sizes)), []
                begin = 0
                while begin < len(sizes):  # as many queries as have so many terms, one at least
                    end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + TERMS_AT_ONCE, side="right")) - 1)
                    wanted, at = np.unique(q_terms[cuts[begin] : cuts[end]], return_inverse=True)
                    trees = Trees(wanted, terms, ends, of, tf, lens, rows, total)
                    for q in range(begin, end):
                        part = slice(cuts[q], cuts[q + 1])
                        found = trees.search(at[part.start - cuts[begin] : part.stop - cuts[begin]], weights[part], int(floor[q]), k)
                        found = sorted((-s, not valid[d], int(ids[d])) for s, d in found)[:k]
                        if len(found) == k:
                            floor[q] = max(floor[q], -found[-1][0])
                        out += [(block, q, int(item_ids[q]), None if none else d, -s) for s, none, d in found]
                    begin = end
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["block", "query", "item_id", "doc_id", "score"])

    levels = max(1, math.ceil(math.log(max(1, n), FACTOR)) + 1)
    draw = F.pmod(F.xxhash64("shard", F.lit("level")), F.lit(1 << 30))
    best = None
    for level in range(levels):
        upto, before = ((1 << 30) / FACTOR ** (levels - 1 - i) if i >= 0 else 0 for i in (level, level - 1))
        part = shards.where((draw >= before) & (draw < upto)).select(*PACKED)
        asked = blocks.withColumn("floors", F.lit(None).cast("array<struct<query: int, low: long>>"))
        if best is not None:
            floors = best.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("query", F.col("score").alias("low"))).alias("floors"))  # of a block's queries
            asked = stored(blocks.join(floors, "block", "left"))
        # The stated queries, in blocks, against the shards: both sides are read where they lie.
        found = part.join(asked.hint("shuffle_replicate_nl")).mapInArrow(run, "block int, query int, item_id long, doc_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        now = stored(_best(found, k))
        if best is not None:
            drop(best)
        best = now
    return best.select("item_id", "rank", "doc_id", "score")

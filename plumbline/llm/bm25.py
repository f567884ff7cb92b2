"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND pruning, merged exactly.

index() turns runs of up to SHARD_DOCS rows into shards, a row of the stored index each.
Document counts, frequencies and the mean length are taken over all shards, so a score does
not depend on how rows fell into shards. A query is a text; all of its terms count, each once.

Queries are dealt by hash into blocks of about BLOCK_QUERIES. A task pairs a shard with a
block as both lie in storage: postings and queries are never shuffled to each other. In a
shard, documents with like words stand side by side in ranges of RANGE, and each frequent
term has its largest score in each range. For a query, the lists of its rarer terms are
added up first. A document is looked at again only if that sum and the range's maxima of the
frequent terms can reach the k-th best score so far; the rest is exact.

The k-th best score is carried from shard to shard in a task, and from one level of shards
to the next between jobs: a level has eight times the shards of all before it, so what a
query brings out of a level does not grow with the number of shards. The levels' best are
merged by score, then smaller doc_id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, prepare, slices, stored

K = 10
K1, B = 1.2, 0.75
RANGE = 64  # documents
FREQUENT = 20  # a term in more than one of so many documents of a shard has range maxima
SHARD_DOCS, SHARD_CHARS = 8192, 12_000_000
BLOCK_QUERIES, AT_ONCE = 2048, 128  # of a task, on average; of a task's inner step
TOGETHER = 4  # blocks, about, that a task searches in a shard once it is unpacked
MANY = 1 / 8  # of a step's queries
CACHED, POSTINGS = 4, 1_000_000  # queries whose lists are copied together, as long as these have no more postings
FACTOR = 8  # between levels of shards
SLACK = 1 - 1e-9  # sums differ in their last digits
ROUGH = 1 - 1e-4  # and much more so in 32 bits, which only decide what is scored exactly

WORD = re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _terms(texts: list[str | None], words: Callable[[str], list] = _words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count), sorted by term and text, and the texts' lengths in words. Terms are XXH64 of the words."""
    parts, lens = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))], np.zeros(len(texts), np.int64)
    for begin, end in slices(texts):  # words as strings take many times their length
        lists = [words(t) if t else [] for t in texts[begin:end]]
        lens[begin:end] = [len(x) for x in lists]
        flat = [w for x in lists for w in x]
        if flat:
            codes, unique = pd.factorize(np.array(flat, dtype=object))
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in unique], np.uint64).view(np.int64)
            joint, count = np.unique(codes * (end - begin) + np.repeat(np.arange(end - begin), lens[begin:end]), return_counts=True)
            parts.append(((begin + joint % (end - begin)).astype(np.int32), hashes[joint // (end - begin)], count.astype(np.int32)))
    text, term, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((text, term))
    return text[order], term[order], count[order], lens


def index(docs: DataFrame) -> DataFrame:
    """A stored row for each shard: shard, rows, words, and packed arrays: terms, lengths of their postings (dfs), docs
    and counts (of as few bytes as hold them) of the postings, lens, ids and valid (false: the id is null) of the
    shard's documents."""
    prepare(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # the same again if the task is run again
        ids: list = []
        texts: list = []
        chars = 0

        def shard() -> pa.RecordBatch:
            text, term, count, lens = _terms(texts)
            head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            df = np.diff(np.append(head, len(term)))
            place = _neighbours(text, count, df, len(texts))
            order = np.argsort(place)
            new = np.lexsort((place[text], np.repeat(np.arange(len(df)), df)))
            packed = [term[head].astype("<i8"), df.astype("<u4"), place[text][new].astype("<u2"), _narrow(count[new]), lens[order].astype("<i8")]
            packed += [np.array([ids[i] or 0 for i in order], "<i8"), np.array([ids[i] is not None for i in order], bool)]
            values = [pa.array([v]) for v in (number, len(ids), int(lens.sum()))]
            return pa.RecordBatch.from_arrays(values + [pa.array([x.tobytes()], pa.binary()) for x in packed], names=["shard", "rows", "words", *PACKED])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                chars += len(t or "")
                if len(ids) >= SHARD_DOCS or chars >= SHARD_CHARS:
                    yield shard()
                    ids, texts, chars, number = [], [], 0, number + 1
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(build, "shard long, rows long, words long, " + ", ".join(f"{c} binary" for c in PACKED)))


PACKED = ["terms", "dfs", "docs", "tf", "lens", "ids", "valid"]


def _narrow(count: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold every count; _counts reads them back."""
    most = int(count.max(initial=0))
    return count.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def _counts(packed: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n if n else 1}")


def _neighbours(text: np.ndarray, count: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """Each document's place in its shard: by the two frequent terms that it has most often, so that languages and
    subjects come together."""
    often = np.repeat((df > n / 32) & (df < n * 0.75), df)
    if not often.any():
        return np.arange(n)
    t, f, c = text[often], np.repeat(np.arange(len(df)), df)[often], count[often]
    order = np.lexsort((f, -c, t))
    t, f = t[order], f[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    best = np.full((2, n), -1)
    best[0, t[first]] = f[first]
    second = first[first + 1 < len(t)] + 1
    second = second[t[second] == t[second - 1]]
    best[1, t[second]] = f[second]
    place = np.empty(n, np.int64)
    place[np.lexsort((best[1], best[0]))] = np.arange(n)
    return place


def query_blocks(queries: DataFrame, shards: DataFrame, rows: float) -> DataFrame:
    """A row for each block of queries: block and packed arrays: query_ids, sizes, the block's terms and their idfs, and
    which of them each query has."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text, term, _, _ = _terms(b["text"].tolist())
            yield pd.DataFrame({"query": b["query"].to_numpy()[text], "query_id": b["query_id"].to_numpy()[text], "term": term})

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, dfs in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), "<i8")), pa.array(np.frombuffer(dfs.as_py(), "<u4").astype(np.int64))], names=["term", "df"])

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["query", "query_id", "term"]).sort_values(["query", "query_id", "term"])
        head = (g[["query", "query_id"]] != g[["query", "query_id"]].shift()).any(axis=1).to_numpy()
        sizes = np.diff(np.append(np.flatnonzero(head), len(g)))
        terms, first, which = np.unique(g["term"].to_numpy(), return_index=True, return_inverse=True)
        packed = [g["query_id"].to_numpy()[head].astype("<i8"), sizes.astype("<i8"), terms.astype("<i8"), g["idf"].to_numpy()[first].astype("<f8"), which.astype("<u4")]
        return pd.DataFrame([[int(g["block"].iloc[0]), *(x.tobytes() for x in packed)]], columns=["block", *ASKED])

    frequencies = shards.select("terms", "dfs").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    text = F.col("text").cast("string")
    asked = queries.where("doc_id is not null").select(F.xxhash64("doc_id", text).alias("query"), F.col("doc_id").cast("long").alias("query_id"), text.alias("text"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    terms = asked.mapInPandas(split, "query long, query_id long, term long").join(frequencies, "term")
    idf = F.log(1 + (F.lit(float(rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    block = F.pmod(F.xxhash64("query", "query_id", F.lit("block")), F.lit(blocks)).cast("int")
    terms = terms.select(block.alias("block"), "query", "query_id", "term", idf.alias("idf"))
    return stored(terms.groupBy("block").applyInPandas(pack, "block int, " + ", ".join(f"{c} binary" for c in ASKED)))


ASKED = ["query_ids", "sizes", "q_terms", "idfs", "which"]


class Shard:
    """A shard's postings: rarer terms as lists, frequent ones as rows over all documents with the maxima of their ranges."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, tf: np.ndarray, lens: np.ndarray, mean: float) -> None:
        norm = K1 * (1 - B + B * lens / mean)
        self.n, self.terms = len(lens), terms
        scores = tf * (K1 + 1) / (tf + norm[docs])
        starts = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else ends
        self.dfs, self.cuts, self.scores = ends - starts, np.append(0, ends).astype(np.int64) * 8, scores
        self.docs = self._lists(docs.astype(np.int64))
        self.range = max(1, min(RANGE, self.n))
        self.width = -(-self.n // self.range) * self.range  # whole ranges
        often = np.flatnonzero(self.dfs > self.n / FREQUENT)
        self.row = np.full(len(terms), -1)
        self.row[often] = np.arange(len(often))
        self.rough = np.zeros((len(often), self.width), np.float32)
        for i, (p, q) in enumerate(zip(starts[often].tolist(), ends[often].tolist(), strict=True)):
            self.rough[i, docs[p:q]] = scores[p:q]
        self.rough = self.rough.reshape(len(often), self.width // self.range, self.range)
        self.exact = np.zeros((self.width, len(often)))
        mine = np.repeat(self.row, self.dfs)
        self.exact[docs[mine >= 0], mine[mine >= 0]] = scores[mine >= 0]
        self.maxima = self.rough.max(axis=2, initial=0)

    def search(self, sizes: np.ndarray, terms: np.ndarray, idfs: np.ndarray, floor: np.ndarray, k: int, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score) with every document that is among the shard's k best of a query (or equals the
        last of them) and whose score reaches the query's floor. What can be is found in 32 bits, scores have 64.
        terms and idfs are those of one query after another, or which says where each query's stand."""
        if not len(self.terms):
            return
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        has = self.terms[at] == terms
        if which is not None:
            at, has, idfs = at[which], has[which], idfs[which]
        owner, at, idfs = owner[has], at[has], idfs[has]
        row = self.row[at]
        often = row >= 0
        weight = np.zeros(len(self.terms))
        weight[at] = idfs
        lists = self._lists(self.scores * np.repeat(weight, self.dfs))
        bounds = np.zeros((len(sizes), self.maxima.shape[1]), np.float32)
        for lo in range(0, len(sizes), AT_ONCE):  # frequent terms' share in each range
            mine = slice(*np.searchsorted(owner, [lo, lo + AT_ONCE]))
            weights = np.zeros((min(AT_ONCE, len(sizes) - lo), len(self.maxima)), np.float32)
            weights[owner[mine][often[mine]] - lo, row[mine][often[mine]]] = idfs[mine][often[mine]]
            bounds[lo : lo + AT_ONCE] = weights @ self.maxima
        # Queries with the same best range side by side: what they have to look at lies in the same ranges.
        order = np.argsort(bounds.argmax(axis=1), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[owner], kind="stable")
        owner, at, idfs, row = rank[owner][by], at[by], idfs[by], row[by]
        cuts = np.searchsorted(owner, np.arange(0, len(sizes) + AT_ONCE, AT_ONCE))
        for step, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
            lo = step * AT_ONCE
            m = min(AT_ONCE, len(sizes) - lo)
            if m <= 0 or p == q:
                continue
            own, t, w, r = owner[p:q] - lo, at[p:q], idfs[p:q], row[p:q]
            low, often = floor[order[lo : lo + m]], r >= 0
            total, most = self._rare(own[~often], t[~often], lists, m)
            weights = np.zeros((m, len(self.maxima)))
            weights[own[often], r[often]] = w[often]
            asked = np.flatnonzero(weights.any(axis=0))  # like queries have few of the frequent terms
            rough = min(ROUGH, 1 - len(asked) * 2.0**-22)  # long sums in 32 bits are less exact
            limit = (np.maximum(low, 1e-30) * rough).astype(np.float32)
            bound = bounds[order[lo : lo + m]]
            alive = most + bound >= limit[:, None]
            # Ranges that many of the queries look at are multiplied, elsewhere documents go on one by one.
            many = alive.sum(axis=0) > m * MANY
            x, cell = np.nonzero(alive & ~many)
            nth, inside = np.nonzero(total.reshape(m, -1, self.range)[x, cell] >= (limit[x] - bound[x, cell])[:, None])
            x, y = x[nth], cell[nth] * self.range + inside
            some, ranges = np.flatnonzero(alive[:, many].any(axis=1)), np.flatnonzero(many)
            if len(some):
                score = weights[np.ix_(some, asked)].astype(np.float32) @ self.rough[np.ix_(asked, ranges)].reshape(len(asked), len(ranges) * self.range)
                score += total.reshape(m, -1, self.range)[np.ix_(some, ranges)].reshape(len(some), -1)
                least = limit[some]
                if score.shape[1] > k and (low <= 0).any():  # later on the floors keep nearly all others out
                    least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] * np.float32(rough))
                i, j = np.nonzero(score >= least[:, None])
                x, y = np.append(x, some[i]), np.append(y, ranges[j // self.range] * self.range + j % self.range)
            for begin in range(0, len(x), 256):
                i, j = x[begin : begin + 256], y[begin : begin + 256]
                exact = total[i, j] + np.einsum("ij,ij->i", weights[i], self.exact[j])
                kept = (exact >= low[i] * SLACK) & (exact > 0)
                yield order[lo + i[kept]], j[kept], exact[kept]

    def _lists(self, values: np.ndarray) -> pa.Array:
        """A list for each term, as bytes: Arrow copies whole lists one behind the other."""
        return pa.Array.from_buffers(pa.large_binary(), len(self.terms), [None, pa.py_buffer(self.cuts), pa.py_buffer(values)])

    def _rare(self, own: np.ndarray, t: np.ndarray, scores: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of m queries over the lists of their rarer terms, and the largest in each range."""
        total = np.zeros((m, self.width))
        done = np.append(0, np.cumsum(self.dfs[t]))[np.searchsorted(own, np.arange(m + 1))]
        begin = 0
        while begin < m:  # a few queries at a time
            end = max(begin + 1, min(begin + CACHED, m, int(np.searchsorted(done, done[begin] + POSTINGS, side="right")) - 1))
            if done[begin] < done[end]:
                lists = pa.array(t[slice(*np.searchsorted(own, [begin, end]))])
                docs, found = (np.frombuffer(pc.take(x, lists, boundscheck=False).buffers()[2], kind) for x, kind in ((self.docs, np.int64), (scores, np.float64)))
                ends = (done[begin : end + 1] - done[begin]).tolist()
                for i, p, q in zip(range(begin, end), ends, ends[1:], strict=False):
                    total[i] = np.bincount(docs[p:q], found[p:q], self.width)
            begin = end
        return total, total.reshape(m, -1, self.range).max(axis=2).astype(np.float32)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("block", "query").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, doc_id and score: the k best rows of docs for each row of queries(doc_id, text).

    Null and empty texts match nothing and have length 0; queries without a term that occurs
    have no rows; null query ids are skipped, rows with a null id are found and come last of
    equals. Repeated rows of docs are found as often as they occur; queries repeated with
    their text are one. Scores are rounded to 9 places, and ranked so.
    """
    shards = index(docs)
    n, rows, words = shards.agg(F.count("*"), F.sum("rows"), F.sum("words")).first()  # one row
    rows, mean = rows or 0, (words or 0) / max(1, rows or 0) or 1.0
    blocks = query_blocks(queries, shards, rows)
    together = max(1, -(-blocks.count() // TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, floors = None, None, {}
        packed = dict(zip([*PACKED, *ASKED], ("<i8", "<u4", "<u2", "<u1", "<i8", "<i8", bool, "<i8", "<i8", "<i8", "<f8", "<u4"), strict=True))
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(c)[i].as_py() for c in ("shard", "block", "floors")}
                arrays = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in packed.items()]
                terms, dfs, of, tf, lens, ids, valid, query_ids, sizes, q_terms, idfs, which = arrays
                if x["shard"] != number:
                    shard = None  # only one is held
                    number, shard = x["shard"], Shard(terms, np.cumsum(dfs, dtype=np.int64), of, _counts(tf, len(of)), lens, mean)
                if x["block"] not in floors:
                    floors[x["block"]] = np.zeros(len(sizes))
                    for f in x["floors"] or []:
                        floors[x["block"]][f["query"]] = f["low"]
                floor = floors[x["block"]]
                found = list(shard.search(sizes, q_terms, idfs, floor, k, which))
                if not found:
                    continue
                query, doc, score = (np.concatenate(v) for v in zip(*found, strict=True))
                # The shard's k best of each query, in the order of the result.
                order = np.lexsort((ids[doc], ~valid[doc], -np.round(score, 9), query))
                head = np.append(True, query[order][1:] != query[order][:-1])
                nth = np.arange(len(order)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                last = order[nth == k - 1]
                floor[query[last]] = np.maximum(floor[query[last]], score[last])
                order = order[nth < k]
                query, doc, score = query[order], doc[order], score[order]
                values = [np.full(len(query), x["block"], np.int32), query.astype(np.int32), query_ids[query]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values] + [pa.array(ids[doc], mask=~valid[doc]), pa.array(score)], names=["block", "query", "query_id", "doc_id", "score"])

    kind = "block int, query int, query_id long, doc_id long, score double"
    levels = max(1, math.ceil(math.log(max(1, n), FACTOR)) + 1)
    draw = F.pmod(F.xxhash64("shard", F.lit("level")), F.lit(1 << 30))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # a row of a pair has some MB itself
    best = None
    for level in range(levels):
        upto, before = ((1 << 30) / FACTOR ** (levels - 1 - i) if i >= 0 else 0 for i in (level, level - 1))
        part = shards.where((draw >= before) & (draw < upto)).select("shard", *PACKED)
        asked = blocks.withColumn("floors", F.lit(None).cast("array<struct<query: int, low: double>>"))
        if best is not None:
            floors = best.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("query", F.col("score").alias("low"))).alias("floors"))  # of a block's queries
            asked = stored(blocks.join(floors, "block", "left"))
        # The stated queries, in blocks, against the shards: both sides are read where they lie.
        found = part.join(asked.coalesce(together).hint("shuffle_replicate_nl")).mapInArrow(run, kind)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        now = stored(_best(found, k))
        if best is not None:
            drop(best)
        best = now
    prepare(docs.sparkSession)
    return best.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def bm25_score(tf: float, df: float, length: float, rows: float, mean: float) -> float:
    """One term's share of a score; what the shards compute, for tests and documentation."""
    return math.log(1 + (rows - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

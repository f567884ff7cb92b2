"""Embedding near-duplicates: cover trees and dual traversal, exact threshold pairs.

Vectors are compared within their label, by cosine. On unit vectors a cosine of COSINE is
a distance, and the trees work with distances. Equal vectors are one class. The classes of
a label are dealt to the nearest of some pivots, one for each block's worth of classes;
pivot and radius of a cell are the top of the hierarchy: pairs of cells that lie further
apart than their radii allow are never built. All pivots together hold at most PIVOT_VALUES
numbers (that is what a task is sent); a larger cell is cut into blocks of BLOCK_VALUES.

Each block's cover tree is built once and written with its vectors as one row. A pair of
blocks of cells that are left is a task's row with the two trees. The task count and the
bytes shipped grow with the pairs of blocks left, not with the pairs of vectors.

A cover tree has levels with halving radii. The centres of a level cover all points within
its radius, are further than it from each other, and are centres of all levels below. Points
are inserted a batch at a time: those that no centre covers become centres one by one. The
traversal starts at both roots, and drops a pair of nodes when the distance of the centres
exceeds the sum of their covering radii (the largest distance to a point below) by more
than the threshold's distance.

A task returns the number of links of each class and a spanning forest, not the pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .components import components, roots

COSINE = 0.93
BLOCK_VALUES = 1 << 20  # numbers in the vectors of a block
PIVOT_VALUES = 1 << 22  # numbers in all pivots
SLACK = 1e-6  # rounding of distances; links are decided on the cosine itself
AT_ONCE = 100_000  # node pairs
TILE = 1024


def _gap(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


class CoverTree:
    """Levels from the root down, levels without a new centre left out; the last holds all points."""

    RADII = (1.0, 0.5, 0.25, 0.125)

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        nets, self.radii = [np.array([0])], []
        for radius in self.RADII:
            net = self._net(units, nets[-1], radius)
            if len(net) > len(nets[-1]):
                nets.append(net)
                self.radii.append(radius)
        if len(nets[-1]) < n or n == 1:
            nets.append(np.arange(n))
        # Children of a node side by side, level by level.
        self.center, self.first, self.last = [nets[0]], [], []
        for above, here in zip(nets, nets[1:], strict=False):
            p = self._parents(units, self.center[-1], here)
            order = np.argsort(p, kind="stable")
            self.center.append(here[order])
            self.first.append(np.searchsorted(p[order], np.arange(len(above)), "left"))
            self.last.append(np.searchsorted(p[order], np.arange(len(above)), "right"))
        top = np.arange(n)  # each leaf's node, from the bottom up
        self.radius = [np.zeros(n)]
        for k in range(len(nets) - 2, -1, -1):
            top = np.repeat(np.arange(len(self.first[k])), self.last[k] - self.first[k])[top]
            r = np.zeros(len(self.first[k]))
            np.maximum.at(r, top, _gap(np.einsum("ij,ij->i", units[self.center[-1]], units[self.center[k][top]])))
            self.radius.insert(0, r)

    @staticmethod
    def _net(units: np.ndarray, above: np.ndarray, radius: float) -> np.ndarray:
        """The centres above and, of the points further than radius from all centres so far, one after another."""
        n, cover = len(units), 1.0 - radius * radius / 2.0
        known = np.zeros(n, bool)
        known[above] = True
        centers, held = [above], units[above]
        for at in range(0, n, TILE):
            rest = at + np.flatnonzero(~known[at : at + TILE])
            for lo in range(0, len(held), 4 * TILE):
                if len(rest):
                    rest = rest[(units[rest] @ held[lo : lo + 4 * TILE].T).max(axis=1) < cover]
            own, open_ = units[rest] @ units[rest].T, np.ones(len(rest), bool)
            new = []
            for i in range(len(rest)):
                if open_[i]:
                    new.append(rest[i])
                    open_ &= own[i] < cover
            if new:
                centers.append(np.array(new))
                held = np.concatenate([held, units[new]])
        return np.concatenate(centers)

    @staticmethod
    def _parents(units: np.ndarray, above: np.ndarray, here: np.ndarray) -> np.ndarray:
        """The nearest centre above of each; a centre above is its own."""
        own = np.full(len(units), -1)
        own[above] = np.arange(len(above))
        p = own[here]
        rest = np.flatnonzero(p < 0)
        for at in range(0, len(rest), TILE):
            part = rest[at : at + TILE]
            best = np.full(len(part), -9.0)
            for lo in range(0, len(above), 4 * TILE):
                dot = units[here[part]] @ units[above[lo : lo + 4 * TILE]].T
                near, value = dot.argmax(axis=1), dot.max(axis=1)
                p[part] = np.where(value > best, lo + near, p[part])
                best = np.maximum(best, value)
        return p


def dual_pairs(a: CoverTree, x_units: np.ndarray, b: CoverTree, y_units: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of pairs of points of both trees within reach; of one tree with itself, each pair once.

    The trees may differ in depth: where one has ended, its leaves stand for themselves.
    """
    same, deep_a, deep_b = a is b, len(a.center) - 1, len(b.center) - 1

    def near(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i, j = min(k, deep_a), min(k, deep_b)
        gap = _gap(np.einsum("ij,ij->i", x_units[a.center[i][x]], y_units[b.center[j][y]]))
        return gap <= reach + a.radius[i][x] + b.radius[j][y] + SLACK

    def children(tree: CoverTree, deep: int, k: int, x: int) -> tuple[int, int]:
        return (int(tree.first[k][x]), int(tree.last[k][x])) if k < deep else (x, x + 1)

    todo = [(0, np.array([0]), np.array([0]))]
    while todo:
        k, x, y = todo.pop()
        if len(x) > AT_ONCE:
            todo.append((k, x[AT_ONCE:], y[AT_ONCE:]))
            x, y = x[:AT_ONCE], y[:AT_ONCE]
        if k >= max(deep_a, deep_b):
            i, j = a.center[-1][x], b.center[-1][y]
            if same:
                once = i != j
                i, j = i[once], j[once]
            yield i, j
            continue
        nx = a.last[k][x] - a.first[k][x] if k < deep_a else np.ones(len(x), np.int64)
        ny = b.last[k][y] - b.first[k][y] if k < deep_b else np.ones(len(y), np.int64)
        large = nx * ny > TILE
        for p, q in zip(x[large].tolist(), y[large].tolist(), strict=True):
            todo += _expanded(a, x_units, children(a, deep_a, k, p), b, y_units, children(b, deep_b, k, q), k + 1, reach, same and p == q)
        x, y, nx, ny = x[~large], y[~large], nx[~large], ny[~large]
        for lo, hi in _portions(nx * ny):
            mx, my = nx[lo:hi], ny[lo:hi]
            many = mx * my
            pair = np.repeat(np.arange(hi - lo), many)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            fx = a.first[k][x[lo:hi]] if k < deep_a else x[lo:hi]
            fy = b.first[k][y[lo:hi]] if k < deep_b else y[lo:hi]
            cx, cy = fx[pair] + nth // my[pair], fy[pair] + nth % my[pair]
            if same:
                once = cx <= cy
                cx, cy = cx[once], cy[once]
            kept = near(k + 1, cx, cy)
            todo.append((k + 1, cx[kept], cy[kept]))


def _expanded(a: CoverTree, x_units: np.ndarray, xs: tuple[int, int], b: CoverTree, y_units: np.ndarray, ys: tuple[int, int], k: int, reach: float, once: bool) -> list:
    """The pairs of children of two nodes with many that are not pruned: centres are multiplied as matrices."""
    i, j = min(k, len(a.center) - 1), min(k, len(b.center) - 1)
    out = []
    for p in range(*xs, TILE):
        left = np.arange(p, min(p + TILE, xs[1]))
        rx, ux = a.radius[i][left], x_units[a.center[i][left]]
        for q in range(*ys, TILE):
            right = np.arange(q, min(q + TILE, ys[1]))
            if once and right[-1] < left[0]:
                continue
            ry = b.radius[j][right]
            dot = ux @ y_units[b.center[j][right]].T
            most = reach + rx.max() + ry.max() + SLACK
            x, y = np.nonzero(dot >= 1.0 - most * most / 2.0) if most < 2.0 else np.nonzero(np.ones_like(dot))
            kept = _gap(dot[x, y]) <= reach + rx[x] + ry[y] + SLACK
            x, y = left[x[kept]], right[y[kept]]
            if once:
                x, y = x[x <= y], y[x <= y]
            if len(x):
                out.append((k, x, y))
    return out


def _portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 5 * AT_ONCE, "right")))
        yield lo, hi
        lo = hi


class Block:
    """A block's classes with their vectors and tree."""

    def __init__(self, rep: np.ndarray, many: np.ndarray, vectors: np.ndarray) -> None:
        self.rep, self.many, self.vectors = rep, many, vectors
        self.tree = CoverTree(self.units())

    def norms(self) -> np.ndarray:
        return np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def units(self) -> np.ndarray:
        return self.vectors / self.norms()[:, None]


def _links(a: Block, b: Block, cosine: float) -> pd.DataFrame:
    """The links of two blocks (or of one with itself): (rep, links, None) counts and (rep, 0, other) forest edges."""
    same = a is b
    rep = a.rep if same else np.concatenate([a.rep, b.rep])
    many = a.many if same else np.concatenate([a.many, b.many])
    shift = 0 if same else len(a.rep)
    na, nb, ua, ub = a.norms(), b.norms(), a.units(), b.units()
    count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i, j in dual_pairs(a.tree, ua, b.tree, ub, (2.0 - 2.0 * cosine) ** 0.5):
        good = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]) / (na[i] * nb[j]) >= cosine
        i, j = i[good], j[good] + shift
        if len(i):
            np.add.at(count, i, many[j])
            np.add.at(count, j, many[i])
            root = roots(len(rep), i, j, root)
    c, e = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(rep)))
    return pd.DataFrame({"a": np.concatenate([rep[c], rep[e]]), "n": np.concatenate([count[c], np.zeros(len(e), np.int64)]), "b": pd.array(np.concatenate([rep[c], rep[root[e]]]), dtype="Int64")})


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that its largest number is near 1: squares of very large and very small numbers
    neither overflow nor vanish, and no digit changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _blocks(dim: int) -> int:
    """Classes of a block."""
    return max(1, BLOCK_VALUES // dim)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components, rows without a
    label and rows without an id link with nothing: n_links is 0, component_id the id, kept
    true. Only vectors of equal length are compared. Rows that repeat an id with its vector
    are one vector. Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("fine", fine).withColumn("key", F.when(F.col("fine"), F.concat_ws(":", F.hex(F.xxhash64("v")), F.hash("v", F.lit(1)).cast("string")))))
    classes = stored(rows.where("fine").groupBy("label", F.size("v").alias("dim"), "key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("many"), F.any_value("v").alias("v")))
    group = ["label", "dim"]
    # Pivots: vectors of the labels that fill more than a block, drawn by a hash, as many as the label's share allows.
    size = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("dim")))
    total = classes.count()
    large = classes.groupBy(*group).count().where(F.col("count") > size)
    room = F.floor(F.col("count") * (PIVOT_VALUES / max(1, total)) / F.col("dim"))
    large = large.select(*group, "count", F.least(F.ceil(F.col("count") / size), room).alias("cells")).where("cells > 1")
    drawn = F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(1 << 30)) < F.col("cells") / F.col("count") * (1 << 30)
    pivots: dict[tuple, list] = {}
    for r in classes.join(large, group).where(drawn).orderBy(*group, "rep").select(*group, "v").toLocalIterator():  # PIVOT_VALUES numbers on average
        pivots.setdefault((r.label, r.dim), []).append(r.v)
    units = {key: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(_scaled(np.array(p))) for key, p in pivots.items()}
    sent = spark.sparkContext.broadcast(units)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, far = np.zeros(len(b), np.int64), np.full(len(b), 2.0)
            for key, at in b.groupby(group).indices.items():
                p = sent.value.get((key[0], int(key[1])))
                if p is not None:
                    x = _scaled(np.stack(b["v"].to_numpy()[at]))
                    dot = (x / np.linalg.norm(x, axis=1)[:, None]) @ p.T
                    cell[at], far[at] = dot.argmax(axis=1), _gap(dot.max(axis=1))
            yield b.assign(cell=cell.astype("int32"), far=far)

    celled = stored(classes.select(*group, "rep", "many", "v").mapInPandas(assign, "label string, dim int, rep long, many long, v array<double>, cell int, far double"))
    cells = celled.groupBy(*group, "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / F.first(size)).cast("int").alias("blocks"))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep")
        block = Block(g["rep"].to_numpy(), g["many"].to_numpy(), _scaled(np.stack(g["v"])))
        out = g[[*group, "cell", "block"]].head(1).copy()
        out["packed"] = [pickle.dumps(block)]
        return out

    named_block = [*group, "cell", "block"]
    number = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    blocks = stored(celled.join(cells, [*group, "cell"]).select(*group, "cell", number, "rep", "many", "v").groupBy(*named_block).applyInPandas(build, "label string, dim int, cell int, block int, packed binary"))
    radii = cells.where("blocks > 0").select(*group, "cell", "radius", "blocks")
    reach = (2.0 - 2.0 * cosine) ** 0.5 + SLACK
    # Cells are at most as many as pivots, or one of a label.
    known = {(r.label, r.dim, r.cell): r.radius for r in radii.join(large, group, "left_semi").toLocalIterator()}
    radius = {key: np.array([known.get((*key, i), -9.0) for i in range(len(p))]) for key, p in units.items()}
    tops = spark.sparkContext.broadcast((units, radius))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each cell with the cells from its own on that its radius reaches."""
        for b in batches:
            others = []
            for label, dim, cell in zip(b["label"], b["dim"], b["cell"], strict=True):
                p, r = (x.get((label, int(dim))) for x in tops.value)
                near = np.array([cell]) if p is None else np.flatnonzero(_gap(p @ p[cell]) <= r[cell] + r + reach)
                others.append(near[near >= cell].astype("int32"))
            yield b[[*group, "cell", "blocks"]].assign(others=others)

    near = radii.mapInPandas(close, "label string, dim int, cell int, blocks int, others array<int>").withColumn("other", F.explode("others"))
    near = near.join(radii.select(*group, F.col("cell").alias("other"), F.col("blocks").alias("other_blocks")), [*group, "other"])
    near = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    near = near.where((F.col("cell") < F.col("other")) | (F.col("block") < F.col("other_block"))).select(*named_block, "other", "other_block")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for one, two in zip(b["packed"], b["second"], strict=True):
                a = pickle.loads(one)
                yield _links(a, a if two is None else pickle.loads(two), cosine)

    kind = "a long, n long, b long"
    inside = blocks.select("packed", F.lit(None).cast("binary").alias("second")).repartition(max(1, blocks.count())).mapInPandas(links, kind)
    second = blocks.select(*group, F.col("cell").alias("other"), F.col("block").alias("other_block"), F.col("packed").alias("second"))
    across = near.join(blocks, named_block).join(second, [*group, "other", "other_block"]).select("packed", "second").mapInPandas(links, kind)
    found = stored(inside.unionByName(across))
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = components(found.where("n = 0").select("a", "b"))
    named = classes.select("label", "dim", "key", "rep", "many").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = stored(named.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = rows.where("fine").select("vec_id", "label", F.size("v").alias("dim"), "key").join(named, ["label", "dim", "key"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

import numpy as np
import pytest

from plumbline.llm import covertree as c


def unit(v):
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def brute(rows):
    """rows: (id, vector, label) -> {id: (links, component)}"""
    def fine(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if fine(v, lab) and i is not None]
    comp, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}
    pairs = []
    for x in range(len(good)):
        for y in range(x):
            (i, v, k), (j, w, m) = good[x], good[y]
            if i != j and k == m and len(v) == len(w) and unit(v) @ unit(w) >= 0.93:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    for _ in range(len(comp)):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (links[i], comp[i]) for i in comp}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // 6), dim))
    x = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.1, 0.3], (n, 1))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_tree_and_dual_traversal():
    x, y = clustered(300, 8, 1), clustered(200, 8, 2)
    y[:50] = x[:50] + 0.01
    y /= np.linalg.norm(y, axis=1)[:, None]
    a, b = c.CoverTree(x), c.CoverTree(y)
    for tree, pts in ((a, x), (b, y)):
        for k, radius in enumerate(tree.radii, 1):
            g = np.sqrt(np.maximum(0, 2 - 2 * pts @ pts[tree.center[k]].T))
            assert (g.min(axis=1) <= radius + 1e-9).all() and set(tree.center[k - 1]) <= set(tree.center[k])
            s = np.sqrt(np.maximum(0, 2 - 2 * pts[tree.center[k]] @ pts[tree.center[k]].T)) + 9 * np.eye(len(tree.center[k]))
            assert (s > radius - 1e-9).all()
    for p, q, t1, t2 in ((x, y, a, b), (x, x, a, a)):
        got = [(i, j) for u, v in c.dual_pairs(t1, p, t2, q, 0.374) for i, j in zip(u.tolist(), v.tolist(), strict=True)]
        d = np.sqrt(np.maximum(0, 2 - 2 * p @ q.T))
        want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(d <= 0.374)), strict=True) if t1 is not t2 or i != j}
        if t1 is t2:
            got = [tuple(sorted(x)) for x in got]
            want = {tuple(sorted(x)) for x in want}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("tile", [1024, 4])
def test_many_children_are_multiplied_as_matrices(monkeypatch, tile):
    monkeypatch.setattr(c, "TILE", tile)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 32))  # far from each other: the root has all of them as children
    x[200:] = x[:200] + rng.normal(size=(200, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = c.CoverTree(x)
    got = [tuple(sorted(z)) for u, v in c.dual_pairs(tree, x, tree, x, 0.374) for z in zip(u.tolist(), v.tolist(), strict=True)]
    assert sorted(got) == [(i, i + 200) for i in range(200)]


@pytest.mark.parametrize("cell,pivots", [(2048, 1 << 22), (25, 1 << 22), (25, 40), (1, 900)])
def test_rows_against_brute_force(spark, monkeypatch, cell, pivots):
    monkeypatch.setattr(c, "BLOCK_VALUES", cell * 6)
    monkeypatch.setattr(c, "PIVOT_VALUES", pivots)
    x = clustered(160, 6, 4)
    rows = [(i, [float(z) for z in v], int(i % 2)) for i, v in enumerate(x)]
    rows += [(500 + i, rows[3][1], 1) for i in range(5)] + [(600, None, 1), (601, [0.0] * 6, 1), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (603, [float("nan")] * 6, 1), (604, [float("inf")] * 6, 1), (605, rows[3][1], None), (606, [], 1), (607, rows[3][1][:5], 1), (503, rows[3][1], 1)]
    rows += [(610, [z * 1e200 for z in rows[3][1]], 1), (611, [z * 1e-200 for z in rows[4][1]], 0)]
    vectors = spark.createDataFrame([(i, v, k, 7) for i, v, k in rows], "vec_id long, embedding array<double>, label int, key int")
    got = c.near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    want = brute(list({r[0]: r for r in rows}.values()))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    if cell == 2048:
        assert c.near_duplicates(vectors.limit(0)).count() == 0
        lone = c.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], vectors.select("vec_id", "embedding", "label").schema)).collect()
        assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in lone) == [(0, 0, True), (1, 0, True)]

import numpy as np
from graphloom.llm import similar
from graphloom.llm.similar import Cell, Leaf, fit_leaves, nearest, rotation, visits
from test_similar import brute, clustered, frame, pairs


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_a_vector_visits_every_leaf_within_the_margin():
    r = np.random.default_rng(3)
    c = unit(np.ones((40, 64)) + 0.05 * r.standard_normal((40, 64)))
    x = unit(np.ones((5, 64)) + 0.05 * r.standard_normal((5, 64)))
    row, leaf, home = visits(x, c, 0.5)
    assert len(row) == 5 * 40 and home.sum() == 5
    angle = np.arccos(np.clip(x @ c.T, -1, 1))
    row, leaf, home = visits(x, c, 0.03)
    assert set(zip(row, leaf)) == set(zip(*np.nonzero(angle <= angle.min(1, keepdims=True) + 0.03)))


def test_a_cell_of_many_vectors_gets_leaves_of_its_own(monkeypatch):
    monkeypatch.setattr(similar, "LEAF", 64)
    x = unit(clustered(4000, 5))
    r = np.random.default_rng(1)
    at_home = r.random(len(x)) < 0.8
    cell = Cell(x, at_home, [np.array([i]) for i in range(len(x))], 5, 0.8, similar.MARGIN, rotation())
    owner, value, other = cell.found(unit(x.mean(0, keepdims=True))[0])
    assert cell.leaves > 10
    got = {(min(a, b), max(a, b)) for a, b in zip(owner.tolist(), other.tolist())}
    want = {(a, b) for a, b in brute(np.arange(len(x)), x) if at_home[a] or at_home[b]}
    assert len(want & got) / len(want) > 0.93


def test_vectors_of_one_direction_end_in_one_leaf(monkeypatch):
    monkeypatch.setattr(similar, "LEAF", 8)
    x = np.repeat(unit(clustered(1, 2)), 200, axis=0)
    cell = Cell(x, np.ones(200, bool), [np.array([i]) for i in range(200)], 5, 0.8, similar.MARGIN, rotation())
    owner, _, _ = cell.found(x[0])
    assert cell.leaves == 1 and set(owner) == set(range(200))


def test_the_kth_best_bounds_what_is_reranked():
    x = unit(np.ones((600, 64)) + 0.15 * np.random.default_rng(4).standard_normal((600, 64)))
    leaf = Leaf(x, unit(x.mean(0, keepdims=True))[0], rotation())
    q, m, value, products = leaf.near(x, 0.8, 6)
    assert products < 600 * 600 / 2  # all pairs reach 0.8
    s = x.astype(np.float64) @ x.T
    kept = [set(m[q == i].tolist()) for i in range(600)]
    hits = sum(len(set(np.argsort(-s[i])[:6].tolist()) & kept[i]) for i in range(600))
    assert hits / 3600 > 0.98


def test_rows_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(similar, "fit_leaves", lambda s, n: fit_leaves(s, n, leaf=128))
    ids, x = np.arange(2500), clustered(2500, 6)
    df = frame(spark, ids, x)
    one, other = df.coalesce(1), df.repartition(7, "vec_id").sortWithinPartitions("embedding")
    assert pairs(nearest(one)) == pairs(nearest(other))

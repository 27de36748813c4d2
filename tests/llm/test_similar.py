import numpy as np
import pytest
from graphloom.llm import similar
from graphloom.llm.similar import Leaf, fit_leaves, nearest, rotation


def brute(ids, x, k=5, least=0.8):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        s = x @ x[i]
        order = np.lexsort((ids, -np.round(s, 6)))
        near = [j for j in order if j != i and s[j] >= least][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in near}
    return {(int(a), int(b)) for a, b in out}


def clustered(n, seed=0, spread=0.6):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(2, n // 12), 64))
    return (centres[r.integers(0, len(centres), n)] + spread * r.standard_normal((n, 64))).astype(np.float32)


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in e]) for i, e in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def pairs(df):
    return {(min(r.vec_id, r.other), max(r.vec_id, r.other)) for r in df.collect()}


def test_bound_holds_for_nearly_all_estimates():
    x = clustered(600)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = fit_leaves(x, len(x), leaf=10**6)[0]
    code, bound = Leaf(x, c, rotation()).estimate(x)
    assert (np.abs(code - x @ x.T) <= bound + 0.02).mean() > 0.97


def test_recall_with_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(similar, "LEAF", 64)
    monkeypatch.setattr(similar, "fit_leaves", lambda s, n: fit_leaves(s, n, leaf=64))
    ids, x = np.arange(3000) * 3, clustered(3000)
    want, got = brute(ids, x), pairs(nearest(frame(spark, ids, x)))
    assert len(want & got) / len(want) > 0.93 and len(want & got) / len(got) > 0.97


def test_exact_in_one_leaf_with_copies_and_unusable_rows(spark):
    x = clustered(300, 1)
    x[250:290] = x[0]
    x[290:295] = x[1]
    ids = np.random.default_rng(2).permutation(1000)[:300]
    extra = [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 63), (5003, [float("nan")] * 64), (5004, [1.0] * 63 + [None]), (None, [1.0] * 64), (5005, [float("inf")] + [1.0] * 63)]
    extra.append((int(ids[7]), [float(v) for v in x[7]]))
    assert pairs(nearest(frame(spark, ids, x, extra))) == brute(ids, x)


def test_empty(spark):
    assert nearest(frame(spark, [], [])).collect() == []

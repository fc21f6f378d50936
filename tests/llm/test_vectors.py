"""Hard negatives and whitening against brute force."""

import numpy as np
import pytest

from maskwright.llm import hard_negatives as hn
from maskwright.llm import whitening as wh

ROW = "vec_id long, label int, embedding array<float>, score string, key string"


def mined(rows, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score), row by row."""
    ok = [(i, lab, np.floor(256 * np.array(v, float)).astype(int)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in ok:
        if i % 100:
            continue
        s = [(-int(v @ w), j, m) for j, m, w in ok if len(w) == len(v)]
        for p, j, m in sorted(x for x in s if x[2] == lab and x[1] != i)[:k]:
            fit = sorted(x for x in s if x[2] != lab and low * -p <= 100 * -x[0] <= high * -p)[:k]
            out += [(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def some_vectors(n=1500, dims=6, seed=3):
    g = np.random.default_rng(seed)
    at = g.normal(size=(12, dims))
    rows = [(int(i), int(g.integers(4)), [float(np.float32(x)) for x in at[g.integers(12)] + 0.2 * g.normal(size=dims)]) for i in range(n)]
    rows += [(n + j, int(g.integers(4)), [1.0] * dims) for j in range(400)]  # one very common vector: ties
    rows += [(5000, 1, None), (5100, None, [1.0] * dims), (5200, 2, [1.0, None] + [0.0] * (dims - 2)), (5300, 2, [float("nan")] * dims), (5400, 3, [float("inf")] * dims), (5500, 1, []), (None, 1, [1.0] * dims)]
    return rows + [(6000, 1, [1.0, 2.0]), (6001, 1, [1.0, 1.0]), (6002, 2, [1.0, 1.1]), (7, 3, rows[7][2]), (-100, 0, rows[0][2])]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_by_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, trees and leaves
        monkeypatch.setattr(hn, "BLOCK_BYTES", 400)
        monkeypatch.setattr(hn, "TREE_ROWS", 300)
        monkeypatch.setattr(hn, "LEAF", 8)
    rows = some_vectors()
    df = spark.createDataFrame([(i, lab, v, "x", "y") for i, lab, v in rows], ROW).repartition(5)
    got = hn.hard_negatives(df, df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], ROW)
    assert hn.hard_negatives(df, df).count() == 0
    df = spark.createDataFrame([(100, 1, [1.0], "", ""), (101, 2, [1.0], "", "")], ROW)
    assert hn.hard_negatives(df, df.where("vec_id = 100")).count() == 0  # no positive


def test_trees_pass_over_most_rows():
    g = np.random.default_rng(1)
    at = g.integers(-200, 200, size=(40, 8))
    which = g.integers(40, size=20000)
    x = at[which] + g.integers(-4, 5, size=(20000, 8))
    tree, q = hn.BallTree(np.arange(20000), which % 5, x), np.arange(0, 20000, 100)
    near = hn.Search(5, q, which[q] % 5, x[q])
    near.over(tree)
    far = hn.Search(5, q, which[q] % 5, x[q], near.score[:, 0] * 80 // 100, near.score[:, 0])
    far.over(tree)
    assert near.met < 0.2 * len(q) * 20000 and far.met < 0.2 * len(q) * 20000


def test_products_are_exact_beyond_doubles():
    a = np.array([[3_000_000_001, 1], [1, 3]])
    assert hn.products(a, a).tolist() == [[3_000_000_001**2 + 1, 3_000_000_004], [3_000_000_004, 10]]
    with pytest.raises(OverflowError):
        hn.products(a * 10, a * 10)


def whitened(x):
    n, s = len(x), x.sum(axis=0)
    mid = (n * x.astype(object) - s.astype(object)).astype(float) / n
    e, q = np.linalg.eigh(mid.T @ mid / n)
    e, q = e[::-1], q[:, ::-1]
    return mid @ q / np.sqrt(np.maximum(e, 1e-30)), e / e.sum(), ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)


def test_whitening_by_eigenvectors(spark):
    g = np.random.default_rng(5)
    v = (g.normal(size=(700, 12)) @ np.diag(np.linspace(3, 0.2, 12))).astype(np.float32)
    rows = [(i, 1, [float(c) for c in x], "a", "b") for i, x in enumerate(v)] + [(3, 1, [float(c) for c in v[3]], "a", "b")]
    bad = [(900, 1, None, "", ""), (901, 1, [None] * 12, "", ""), (902, 1, [float("nan")] * 12, "", ""), (903, 1, [], "", ""), (904, 1, [1.0, 2.0], "", ""), (905, 1, [3e38] * 12, "", "")]
    df = spark.createDataFrame(rows + bad, ROW).repartition(11)
    got = wh.whiten(df).toPandas()
    x = np.floor(1024 * np.array([r[2] for r in rows])).astype(np.int64) + 100_000
    w, share, dev = whitened(x)
    assert len(got) == 701 * 8 and set(got.n) == {701} and got.identity_error.max() < 1e-12
    one = got.drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    mine = one.whitened.to_numpy().reshape(700, 8)
    sign = np.sign((mine * w[:700, :8]).sum(axis=0))
    assert np.abs(mine * sign - w[:700, :8]).max() < 1e-9
    assert np.allclose(one.explained.to_numpy().reshape(700, 8)[0], share[:8], rtol=1e-9)
    assert one[one.component == 1].deviation.tolist() == dev[:700].tolist()


def test_whitening_without_variance_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0], "", "")] * 3, ROW)
    assert wh.whiten(df).count() == 0 and wh.whiten(df.where("vec_id > 1")).count() == 0
    df = spark.createDataFrame([(i, 1, [float(i % 3), 5.0, 2.0 * (i % 3)], "", "") for i in range(9)], ROW)
    assert {r["component"] for r in wh.whiten(df).collect()} == {1}  # rank one


def test_whitening_keeps_small_directions():
    """A direction 1e-7 of the largest is lost where the covariance is formed, not by R factors."""
    g = np.random.default_rng(2)
    x = np.column_stack([g.integers(-(1 << 30), 1 << 30, 400), g.integers(-50, 51, 400)]) + 100_000
    frame = wh.Frame(400, [int(s) for s in x.sum(axis=0)])
    r = None
    for part in np.array_split(x, 7):
        r = wh._merge(r, frame.centred(part))
    s = np.linalg.svd(r, compute_uv=False)
    exact = np.linalg.svd(frame.centred(x), compute_uv=False)
    assert np.allclose(s, exact, rtol=1e-8)


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [-(1 << 40), 5], [7, 7]])
    frame = wh.Frame(3, [int(s) for s in x.sum(axis=0)])
    assert frame.deviation(x) == whitened(x)[2].tolist()

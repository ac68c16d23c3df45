"""Whitening against exact rational covariances and a 50-digit eigenvalue check."""
from fractions import Fraction

import numpy as np
import pytest

from corpuscope.llm import whitening


def brute(rows, components=4):
    """(n, sums, exact covariance, integer vectors by id) of the rows with usable vectors."""
    x = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = [[sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in fit) / n for j in range(d)] for i in range(d)]
    return n, s, cov, x, fit


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 6)) * [3, 2, 1.5, 1, .5, .2] + [900, 0, -20, 0, 0, 1]
    vectors = [v.astype(np.float32).tolist() for v in base]
    rows = list(enumerate(vectors)) + [(100, vectors[0]), (100, vectors[1]), (None, vectors[2]), (101, None), (102, []), (103, [float("nan")] + vectors[0][1:]),
                                       (104, [None] + vectors[0][1:]), (105, [float("inf")] + vectors[0][1:]), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, x string, part int, dimension int, w double")
    got = whitening.whiten(df.repartition(5)).collect()
    n, s, cov, x, fit = brute([r for r in rows if r[0] != 106])
    assert n == 60 and len(got) == 4 * len(x) and {(r["n"]) for r in got} == {60}
    values, vecs = np.linalg.eigh(np.array(cov, float))
    values, vecs = values[::-1], vecs[:, ::-1]
    want = {}
    for i, v in x:
        y = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(v, s)])
        want.setdefault(i, []).append((sum((n * a - b)**2 for a, b in zip(v, s)), tuple(np.abs(y @ vecs[:, :4] / np.sqrt(values[:4])))))
    for i, some in want.items():
        for c in range(4):
            mine = sorted((int(r["deviation"]), abs(r["whitened"])) for r in got if r["vec_id"] == i and r["component"] == c + 1)
            assert [a for a, _ in mine] == sorted(a for a, _ in some)
            assert np.allclose([b for _, b in mine], [b for _, b in sorted((a, w[c]) for a, w in some)], rtol=1e-9, atol=1e-9)
    assert all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9 for r in got)


def test_a_third_of_copies_counts_once(spark):
    rng = np.random.default_rng(2)
    some = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 3 * 70 and got[0]["n"] == 41 and max(r["component"] for r in got) == 3


def test_many_tasks_are_added_up_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    whole = {(r["vec_id"], r["component"]): tuple(r) for r in whitening.whiten(df).collect()}
    monkeypatch.setattr(whitening, "HELD", 1)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df.repartition(16)).collect()}
    assert got.keys() == whole.keys() and all(got[k]["deviation"] == whole[k][3] and abs(abs(got[k]["whitened"]) - abs(whole[k][4])) < 1e-12 for k in got)


def test_batches_of_either_sign_add_up(spark):
    """A carry runs through all limbs when the sum of a task changes its sign from one batch to the next."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 3)) * [3, 100, .01])]
    n, s, _, x, _ = brute(rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4")
    try:
        got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    finally:
        spark.conf.set(size, before)
    want = {i: sum((n * a - b)**2 for a, b in zip(v, s)) for i, v in x}
    assert len(got) == 3 * len(x) and all(r["n"] == n and r["deviation"] == want[r["vec_id"]] and r["identity_error"] < 1e-9 for r in got)


def test_nothing_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)} and line[0]["explained"] == 1


def test_entries_beyond_64_bits_when_squared(spark):
    rows = [(1, [1e30, 0.5]), (2, [-1e30, 2.0]), (3, [3.0, 1e300]), (4, [1e9, -1e308])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    clip = [[max(-2**63, min(2**63 - 1, int(np.floor(256 * c) if abs(c) < 1e300 else np.sign(c) * 1e300))) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*clip)]
    for r in got:
        dev = sum((4 * a - b)**2 for a, b in zip(clip[r["vec_id"] - 1], s))
        assert r["deviation"] == (dev if dev < 10**38 else None)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, .5], [1, 1 + 1e-9, 1 + 2e-9, .5, .5 + 1e-12, .1], [3, 3, 3, 1, 1, 1], [1, 1e-6, 1e-9, 1e-12, 0, 0], [1 + 1e-7, 1, 1 - 1e-7, 1 - 2e-7, 1e-8, 1e-8]])
def test_refined_vectors(values):
    """The residual falls to double precision of the matrix, also inside clusters that float32 cannot see."""
    rng = np.random.default_rng(4)
    d = 24
    values = np.sort(np.append(values, rng.random(d - len(values)) * 1e-3))[::-1]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - .5 * q.T @ q)
    a = q @ np.diag(values.astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2
    high = a.astype(np.float64)
    got, x = whitening.eigen(high, (a - high).astype(np.float64))
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-17
    assert np.abs(values - got).max() < 1e-17
    for c in range(d):  # a vector is as right as the distance of its value from the next one allows
        gap = np.abs(np.delete(values, c) - values[c]).min()
        if gap >= 1e-13:
            off = q[:, c] * np.sign(q[:, c] @ x[:, c]) - x[:, c]
            assert np.linalg.norm(off.astype(float)) * gap < 1e-17


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for high in (10, 2**20, 2**30, 2**62):
        y = rng.integers(-high, high, (50, 4))
        o = y.astype(object)
        assert (whitening.unlimbed(whitening.products(y)) == o.T @ o).all()

import numpy as np
import pytest

from formline.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>"


def whole(v):
    return [int(np.floor(64 * c)) + 1_000_000 for c in v]


def check(spark, rows, k=16):
    """Every row against plain eigenvectors of the covariance of the distinct vectors."""
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA), k).collect()
    x = [(i, whole(v)) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), [sum(map(int, column)) for column in fit.T]
    mean = np.array([s / n for s in sums])
    centred = fit - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = [j for j in np.argsort(-values)[:k] if values[j] > 1e-9 * values.max()]
    assert len(got) == len(rows) * len(order)
    whitened = {}
    for r in got:
        whitened.setdefault(r["component"], []).append((r["vec_id"], r["deviation"], r["whitened"], r["explained"]))
        assert r["n"] == n and r["identity_error"] < 1e-8
    for c, j in enumerate(order, 1):
        want = sorted((i, sum((n * a - s) ** 2 for a, s in zip(v, sums)), float((np.array(v) - mean) @ axes[:, j] / np.sqrt(values[j]))) for i, v in x)
        mine = sorted(whitened[c])
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(want, mine)))
        for a, b in zip(want, mine):
            assert a[:2] == b[:2] and b[2] * sign == pytest.approx(a[2], abs=1e-7)
            assert b[3] == pytest.approx(values[j] / values.sum(), rel=1e-6)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    spread = rng.normal(0, 1, (20, 20)) * np.geomspace(3, 0.05, 20)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 20) @ spread]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(5, rows[7][1])]  # one vector repeated, one id repeated
    check(spark, rows)


def test_fewer_dimensions_and_dependent_ones(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-640, 640, (90, 3)) / 64  # whole numbers after scaling, so dependence is exact
    check(spark, [(i, [float(a), float(b), float(c), float(a + b), 1.5]) for i, (a, b, c) in enumerate(base)])


def test_odd_rows_take_no_part(spark):
    good = [(i, [float(i), float(i * i % 7)]) for i in range(12)]
    odd = [(90, None), (91, []), (92, [1.0, None]), (93, [float("nan"), 0.0]), (94, [float("inf"), 0.0]), (95, [1.0, 2.0, 3.0]), (96, [1e20, 0.0])]
    frames = [sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect())
              for rows in (good, good + odd)]
    assert frames[0] == frames[1] and len(frames[0]) == 24
    assert {r["vec_id"] for r in wh.whiten(spark.createDataFrame(good + [(None, [2.0, 2.0])], SCHEMA)).collect()} == {None, *range(12)}


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.001])]):
        got = wh.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_that_do_not_fit_are_null(spark):
    rows = [(0, [0.0]), (1, [1e9]), (2, [1.0])]
    got = {r["vec_id"]: r["deviation"] for r in wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] is None


def test_other_columns_and_floats(spark):
    df = spark.createDataFrame([(i, [float(i)], i, "n") for i in range(5)], "vec_id int, embedding array<float>, x int, n string")
    assert wh.whiten(df).count() == 5


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (60, 12)) * np.geomspace(1, 1e-5, 12)
    v = a.T @ a
    factor = wh.pivoted_cholesky(v)
    assert np.abs(factor @ factor.T - v).max() < 1e-12 * v.max()
    assert sorted((row == 0).sum() for row in factor) == list(range(12))  # triangular in pivot order
    values, axes = wh.jacobi(factor)
    assert np.abs(axes.T @ axes - np.eye(12)).max() < 1e-12
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-5, atol=1e-13)
    assert (np.diff(values) <= 0).all()

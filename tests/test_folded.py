"""Fits of all folds at once against plain optimisation of every fold alone."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline import constants as K
from formline.operators import folded, models as MD, splits as SP


def outcome_rows(n=1200, p=3, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, p)) * [1, 50, 0.01] + [0, 1500, 3]
    eta = np.column_stack([x[:, 0], np.zeros(n), (x[:, 1] - 1500) / 50])
    y = (eta + rng.gumbel(size=eta.shape)).argmax(axis=1)
    return x, y


def folds_of(spark, x, y, n_splits=5):
    rows = [(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, res int").withColumns({"hg": F.col("res"), "ag": F.lit(2) - F.col("res")})
    return SP.time_series_folds(df, ["id"], n_splits).cache()


def objective(beta, x, y, w):
    """Mean weighted loss with the penalty on standardised slopes, for coefficients of the raw features."""
    eta = beta[:, 0] + x @ beta[:, 1:].T
    top = eta.max(axis=1)
    loss = top + np.log(np.exp(eta - top[:, None]).sum(axis=1)) - eta[np.arange(len(y)), y]
    return (w * loss).sum() / w.sum() + MD.OUTCOME_PENALTY / 2 * ((beta[:, 1:] * x.std(axis=0, ddof=1)) ** 2).sum()


def test_every_fold_is_at_its_own_optimum(spark):
    x, y = outcome_rows()
    folds = folds_of(spark, x, y)
    fits, rows, parts = MD.fit_outcome_folds(folds, ["a", "b", "c"], K.DRAW_WEIGHT, final=True)
    starts = {r["fold"]: r["start"] for r in SP.fold_borders(folds).collect()} | {None: len(y)}
    assert set(fits) == set(starts)
    rng = np.random.default_rng(0)
    for fold, fit in fits.items():
        own = slice(0, starts[fold])
        w = np.where(y[own] == 1, K.DRAW_WEIGHT, 1.0)
        best = objective(fit.beta, x[own], y[own], w)
        for _ in range(40):
            step = rng.normal(0, 1e-3, fit.beta.shape) / np.array([1, 1, 50, 0.01])
            assert objective(fit.beta + step, x[own], y[own], w) > best
    report = MD.outcome_report(rows, fits, parts).collect()
    assert len(report) == 18 and max(r["worst_slope"] for r in report) < 1e-9
    for r in report:
        n = starts[r["fold"]]
        w = np.where(y[:n] == 1, K.DRAW_WEIGHT, 1.0)
        assert r["n_train"] == n and r["mean_probability"] == pytest.approx((w * (y[:n] == r["res"])).sum() / w.sum(), abs=1e-9)


def test_scores_are_the_fits_and_native_columns_agree(spark):
    x, y = outcome_rows(300)
    folds = folds_of(spark, x, y)
    fits, rows, _ = MD.fit_outcome_folds(folds, ["a", "b", "c"])
    got = {r["pos"]: r for r in MD.score_folds(rows, fits).collect()}
    assert len(got) == 250
    for fold, fit in fits.items():
        for r in fit.with_probabilities(folds.where(F.col("fold") == fold)).collect():
            for c in ("p_away", "p_draw", "p_home"):
                assert r[c] == pytest.approx(got[r["pos"]][c], abs=1e-12)


def test_early_stopping_keeps_the_best_step_for_rows_held_back(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(0, 1, (160, 3)), rng.integers(0, 3, 160)  # noise: later steps only overfit
    folds = folds_of(spark, x, y)
    stopped, rows, parts = MD.fit_outcome_folds(folds, ["a", "b", "c"], early_stopping=True)
    for fold, problem in zip(stopped, parts["problems"]):
        n = int(problem.end)
        held = slice(int(problem.held), n)
        assert n - int(problem.held) == max(1, n // 10)

        def loss(beta):
            eta = beta[:, 0] + x[held] @ beta[:, 1:].T
            return float((np.log(np.exp(eta).sum(axis=1)) - eta[np.arange(n - int(problem.held)), y[held]]).mean())

        assert loss(stopped[fold].beta) <= math.log(3) + 1e-9  # the first step, even odds, is one of those compared
    flagged = SP.early_stop_flag(folds.where(F.col("pos") < parts["problems"][0].end), F.lit(parts["problems"][0].end))
    assert flagged.where("is_validation").agg(F.min("pos")).first()[0] == parts["problems"][0].held


def test_constant_and_repeated_features_settle(spark):
    x, y = outcome_rows(400)
    x = np.column_stack([x[:, 0], x[:, 0], np.full(400, 7.0)])
    fits, rows, parts = MD.fit_outcome_folds(folds_of(spark, x, y), ["a", "b", "c"], final=True)
    assert max(r["worst_slope"] for r in MD.outcome_report(rows, fits, parts).collect()) < 1e-9
    assert np.allclose(fits[None].beta[:, 3], 0) and np.allclose(fits[None].beta[:, 1], fits[None].beta[:, 2])


def test_goal_fits_of_all_folds_equal_fits_alone(spark):
    rng = np.random.default_rng(2)
    n = 600
    names = sorted({f for side in MD.GOAL_FEATURES["mixed"] for f in side})
    x = {f: rng.normal(1, 0.4, n) for f in names}
    hg = rng.poisson(np.exp(0.1 + 0.3 * x["Home_Form"] - 0.2 * x["Away_Avg_GA"]))
    ag = rng.poisson(np.exp(0.2 * x["Away_Form"]))
    rows = [(i, int(hg[i]), int(ag[i]), int(np.sign(hg[i] - ag[i]) + 1), *[float(x[f][i]) for f in names]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, hg int, ag int, res int, " + ", ".join(f"{f} double" for f in names))
    folds = SP.time_series_folds(df, ["id"]).cache()
    home, away, narrow, parts = MD.fit_goal_folds(folds, "mixed")
    for f in range(1, 6):
        train = folds.where(F.col("pos") < SP.fold_borders(folds).where(F.col("fold") == f).first()["start"])
        for fit, label in ((home, "hg"), (away, "ag")):
            alone = MD.fit_poisson(train, [(fit.features, label)], 0.01)[0]
            assert np.abs(alone.beta - fit.betas[f - 1]).max() < 1e-8
        if f in (1, 5):
            h, a = (MD.PoissonFit(fit.features, [fit.betas[f - 1]]) for fit in (home, away))
            rated = train.withColumns({"lh": h.rate(), "la": a.rate()})
            assert MD.rho_folds(narrow, parts)[f - 1] == pytest.approx(MD.estimate_rho(rated, "lh", "la")[0], abs=1e-9)
    assert max(r["worst_slope"] for r in MD.goal_report(narrow, parts, "mixed").collect()) < 1e-9


def test_fits_that_do_not_settle_stop_the_job(spark):
    x, y = outcome_rows(200)
    with pytest.raises(RuntimeError, match="did not settle"):
        MD.fit_outcome_folds(folds_of(spark, x, y), ["a", "b", "c"], max_iter=2)

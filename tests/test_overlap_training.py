"""Correlations by Gram matrices, and the production training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import quality as Q


def test_correlations_are_those_of_complete_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (900, 4)) + [0, 1e6, -3, 5]
    x[:, 2] += x[:, 0]
    x[rng.random((900, 4)) < 0.1] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in row] + [7.0, None] for row in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, flat double, none double").repartition(5)
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in Q.feature_correlations(df, ["a", "b", "c", "d", "flat", "none"]).collect()}
    for i, p in enumerate("abcd"):
        for j, q in enumerate("abcd"):
            if i < j:
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                assert got[p, q][0] == both.sum() and got[p, q][1] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
        assert got[p, "flat"][1] is None and (p, "none") not in got
    assert Q.feature_correlations(df.limit(0), ["a", "b"]).count() == 0


def test_overlap_report_and_verdicts(spark):
    pairs = [("new", "old", 9, -0.96), ("new", "other", 9, 0.2), ("new", "next", 9, 0.9), ("next", "old", 9, 0.86), ("next", "other", 9, None), ("old", "other", 9, 0.1)]
    report = Q.overlap_report(spark.createDataFrame(pairs, "a string, b string, n long, r double"), ["new", "next"], ["old", "other"])
    got = {(r["candidate"], r["other"]): (r["kind"], r["band"]) for r in report.collect()}
    assert got == {("new", "old"): ("existing", "redundant"), ("new", "other"): ("existing", "incremental"), ("new", "next"): ("candidate", "marginal"),
                   ("next", "old"): ("existing", "marginal"), ("next", "other"): ("existing", "incremental"), ("next", "new"): ("candidate", "marginal")}
    verdicts = {r["candidate"]: (r["nearest"], r["max_r"], r["verdict"]) for r in Q.overlap_verdicts(report).collect()}
    assert verdicts == {"new": ("old", 0.96, "redundant"), "next": ("old", 0.86, "marginal")}


def test_production_training_uses_segments_and_holds_back_rows(spark):
    from formline.plans.training import train_production
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x = float(rng.normal())
        rows.append((i, f"20{i // 150 + 20}", i % 150, x, int(np.clip(round(x + rng.normal(0, .5)), -1, 1) + 1)))
    df = spark.createDataFrame(rows, "match_id long, season string, day int, x double, res int")
    df = df.withColumn("date", F.expr("date_add(make_date(int(season), 1, 1), day)"))
    model, oof, lines = train_production(df, ["date", "match_id"], ["x"])
    got = {r["fold"]: r for r in lines.collect()}
    assert {f: (r["n_train"], r["n_held"], r["n_tested"]) for f, r in got.items()} == {1: (135, 15, 150), 2: (270, 30, 150), 3: (405, 45, 150)}
    assert all(r["log_loss"] < np.log(3) and r["accuracy"] > 0.5 for r in got.values())
    assert oof.count() == 450 and model.beta.shape == (3, 2) and model.beta[2, 1] > model.beta[0, 1]

"""Folds, fits, scores and comparisons on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline import constants as K
from formline.operators import compare as C, metrics as M, models as MD, splits as SP
from formline.sinks import runs as RN
from helpers import plain_bootstrap_weights


def test_time_series_folds(spark):
    rows = spark.range(23).withColumn("k", F.lit(100) - F.col("id"))
    got = SP.time_series_folds(rows, ["k"]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(23)) and [r["id"] for r in got] == list(range(22, -1, -1))
    size = 23 // 6
    want = [0] * (23 - 5 * size) + [f for f in range(1, 6) for _ in range(size)]
    assert [r["fold"] for r in got] == want


def test_ordinal_on_one_hot_key(spark):
    rows = spark.range(5000).withColumn("k", F.lit(1))
    got = SP.with_ordinal(rows, ["k", "id"], "pos", total="n")
    assert got.filter("pos = id and n = 5000").count() == 5000


def brute_segment_folds(labels, k=5):
    """fold per row (None if never tested), from the segment sizes."""
    starts = [i for i in range(len(labels)) if i == 0 or labels[i] != labels[i - 1]]
    s = len(starts)
    k = min(k, max(2, s))
    per = max(1, s // k)
    out = [None] * len(labels)
    for f in range(1, k):
        for seg in range(f * per, min((f + 1) * per, s)):
            for i in range(starts[seg], starts[seg + 1] if seg + 1 < s else len(labels)):
                out[i] = f
    return out


@pytest.mark.parametrize("labels", ["aabbbccddddeeff", "aabbaabbccaadd", "abc", "aabbccddeeffgghhiijjkk"])
def test_group_folds(spark, labels, monkeypatch):
    monkeypatch.setattr(SP, "BLOCK", 4)
    rows = spark.createDataFrame(list(enumerate(labels)), "id long, g string")
    got = SP.group_folds(rows, ["id"], "g").orderBy("id").collect()
    assert [r["fold"] for r in got] == brute_segment_folds(labels)


def test_too_few_segments_fall_back(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(12)], "id long, g string")
    with pytest.warns(UserWarning):
        got = SP.group_folds(rows, ["id"], "g").orderBy("id").collect()
    assert [r["fold"] for r in got] == [None, None, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_early_stop(spark):
    got = SP.early_stop_flag(spark.range(25).withColumnRenamed("id", "pos"), F.lit(25)).filter("is_validation").collect()
    assert sorted(r["pos"] for r in got) == [23, 24]


def oof_rows(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = [rng.random() + 0.05 for _ in range(3)]
        s = sum(p)
        rows.append((i, i % 3 + 1, rng.randrange(3), *[x / s for x in p]))
    return rows


OOF = "pos long, fold int, y_true int, p_away double, p_draw double, p_home double"


def brute(rows):
    acc = np.mean([int(np.argmax(r[3:])) == r[2] for r in rows])
    ll = np.mean([-math.log(max(r[3 + r[2]], 1e-15)) for r in rows])
    br = np.mean([sum((r[3 + k] - (r[2] == k)) ** 2 for k in range(3)) for r in rows])
    return acc, ll, br


def test_scores(spark):
    rows = oof_rows(200) + [(200, 1, 0, 0.4, 0.4, 0.2), (201, 1, 2, 1.0, 0.0, 0.0)]
    oof = spark.createDataFrame(rows, OOF)
    got = M.overall(oof).first()
    assert (got["accuracy"], got["log_loss"], got["brier"]) == pytest.approx(brute(rows))
    s = M.summary(oof).first()
    folds = [brute([r for r in rows if r[1] == f]) for f in (1, 2, 3)]
    assert s["std_log_loss"] == pytest.approx(np.std([f[1] for f in folds])) and s["oof_n"] == 202
    cells = {r["y_true"]: (r["pred_0"], r["pred_1"], r["pred_2"]) for r in M.confusion(oof).collect()}
    want = np.zeros((3, 3), int)
    for r in rows:
        want[r[2], int(np.argmax(r[3:]))] += 1
    assert [list(cells[k]) for k in range(3)] == want.tolist()


def test_no_true_draws_means_zero_recall(spark):
    got = M.draw_report(spark.createDataFrame([(0, 1, 2, .2, .5, .3)], OOF)).first()
    assert got["draw_pred"] == 1 and got["draw_recall"] == 0.0


def test_paired_guards(spark):
    rows = oof_rows(20)
    base = spark.createDataFrame(rows, OOF)
    with pytest.raises(Exception, match="row sets differ"):
        C.paired(base, spark.createDataFrame(rows[:-1], OOF)).collect()
    other = [rows[0][:2] + ((rows[0][2] + 1) % 3,) + rows[0][3:]] + rows[1:]
    with pytest.raises(Exception, match="labels differ"):
        C.paired(base, spark.createDataFrame(other, OOF)).collect()


@pytest.mark.parametrize("n", [1500, 9000])
def test_bootstrap_matches_plain_bootstrap(spark, n):
    rng = np.random.default_rng(3)
    delta = rng.normal(0.01, 0.3, n)
    rows = [(i, 1, 0, float(d), float(-d)) for i, d in enumerate(delta)]
    df = spark.createDataFrame(rows, "pos long, fold int, y_true int, ll_delta double, brier_delta double")
    plain = np.array([delta[rng.integers(0, n, size=n)].mean() for _ in range(3000)])
    got = {r["measure"]: r for r in C.bootstrap_ci(df, 3000).collect()}
    low, high = np.percentile(plain, [2.5, 97.5])
    near = 0.1 * (high - low)
    assert got["ll_delta"]["ci_low"] == pytest.approx(low, abs=near)
    assert got["ll_delta"]["ci_high"] == pytest.approx(high, abs=near)
    assert got["ll_delta"]["mean_delta"] == pytest.approx(delta.mean()) and got["ll_delta"]["n"] == n
    assert got["brier_delta"]["ci_high"] == pytest.approx(-low, abs=near)


def test_bootstrap_weights_are_poisson_and_independent(spark):
    items = spark.range(4000).selectExpr("id * 3 + 1000000000000 AS item").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(299)).cast("array<long>")))
    rows = items.withColumn("x", C._mixed(F.col("item"), F.col("b"), C.SEED)).select("item", "b", C.poisson_weight(F.col("x")).alias("w"))
    w = rows.orderBy("item", "b").toPandas()["w"].to_numpy().reshape(4000, 300)
    assert (w == plain_bootstrap_weights(np.arange(4000) * 3 + 10 ** 12, np.arange(300))).all()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert [abs((w == k).mean() - np.exp(-1) / f) < 0.003 for k, f in ((0, 1), (1, 1), (2, 2), (3, 6))] == [True] * 4
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.08
    assert np.abs(np.corrcoef(w[:40]) - np.eye(40)).max() < 0.3


def test_bootstrap_buckets_hold_every_row_once(spark):
    df = spark.range(50_000).selectExpr("id AS pos", "id % 7 - 3.0D AS ll_delta", "1.0D AS brier_delta")
    got = C.bootstrap_buckets(df).toPandas()
    assert len(got) == C.BUCKETS and got["n"].sum() == 50_000 and got["brier_delta"].sum() == 50_000
    assert abs(got["n"].var() / got["n"].mean() - 1) < 0.1
    assert got["ll_delta"].sum() == pytest.approx(sum(i % 7 - 3.0 for i in range(50_000)))


def test_bootstrap_resamples_single_rows(spark):
    """More rows than any fixed number of groups: every row has weights of its own."""
    n, draws = 6000, 200
    delta = np.random.default_rng(5).normal(0.01, 0.3, n)
    pos = np.arange(n) * 2 + 2 ** 31 - 5000
    df = spark.createDataFrame([(int(p), float(d), float(2 * d)) for p, d in zip(pos, delta)], "pos long, ll_delta double, brier_delta double")
    w = plain_bootstrap_weights(pos, np.arange(draws))
    low, high = np.percentile(delta @ w / w.sum(axis=0), [2.5, 97.5])
    got = {r["measure"]: (r["ci_low"], r["ci_high"]) for r in C.bootstrap_ci(df, draws).collect()}
    assert got["ll_delta"] == pytest.approx((low, high), abs=1e-12)
    assert got["brier_delta"] == pytest.approx((2 * low, 2 * high), abs=1e-12)


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(i, 1, 0, float(i % 7 - 3), 0.0) for i in range(100)],
                               "pos long, fold int, y_true int, ll_delta double, brier_delta double")
    assert sorted(C.bootstrap_ci(df, 500).collect()) == sorted(C.bootstrap_ci(df, 500).collect())


def test_verdict(spark):
    rows = [("a", -0.02, -0.01), ("b", 0.01, 0.02), ("c", -0.00865, 0.00019)]
    df = spark.createDataFrame(rows, "measure string, ci_low double, ci_high double")
    got = {r["measure"]: r["verdict"] for r in C.with_verdict(df).collect()}
    assert got == {"a": "IMPROVEMENT", "b": "DEGRADATION", "c": "INCONCLUSIVE"}


def test_poisson_fit_is_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (800, 2))
    y = rng.poisson(np.exp(0.2 + 0.3 * x[:, 0] - 0.2 * x[:, 1]))
    rows = [(float(a), float(b), int(c), i % 2 + 1) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y int, g int")

    def gradient(beta, mask):
        design = np.column_stack([np.ones(mask.sum()), x[mask]])
        g = design.T @ (np.exp(design @ beta) - y[mask]) / mask.sum()
        return g + 0.01 * np.array([0, *beta[1:]])

    alone = MD.fit_poisson(df, [(["x1", "x2"], "y")], 0.01)[0]
    assert np.abs(gradient(alone.beta, np.ones(800, bool))).max() < 1e-8
    by_group = MD.fit_poisson(df, [(["x1", "x2"], "y")], 0.01, "g", 2)[0]
    odd = np.arange(800) % 2 == 1
    assert np.abs(gradient(by_group.betas[0], ~odd)).max() < 1e-8
    assert np.abs(gradient(by_group.betas[1], odd)).max() < 1e-8


def test_rho_matches_a_fine_scan(spark):
    rng = np.random.default_rng(5)
    lh, la = rng.uniform(0.6, 2.0, 600), rng.uniform(0.5, 1.6, 600)
    hg, ag = rng.poisson(lh), rng.poisson(la)
    df = spark.createDataFrame([tuple(map(float, r[:2])) + (int(r[2]), int(r[3])) for r in zip(lh, la, hg, ag)],
                               "lh double, la double, hg int, ag int")

    def loglik(rho):
        total = 0.0
        for a, b, h, g in zip(lh, la, hg, ag):
            tau = {(0, 0): 1 - a * b * rho, (1, 0): 1 + b * rho, (0, 1): 1 + a * rho, (1, 1): 1 - rho}.get((h, g))
            if tau is not None:
                total += math.log(max(math.exp(-a - b) * a ** h * b ** g * tau, 1e-15))
        return total

    best = max(np.arange(-0.3, 0.3001, 0.001), key=loglik)
    assert MD.estimate_rho(df, "lh", "la")[0] == pytest.approx(best, abs=0.0015)


def test_cross_validation_runs_on_earlier_rows_only(spark):
    rng = random.Random(2)
    rows = []
    for i in range(360):
        x = rng.uniform(-1, 1)
        rows.append((i, x, 2 if x + rng.gauss(0, .3) > .3 else 0 if x < -.3 else 1))
    folds = SP.time_series_folds(spark.createDataFrame(rows, "id long, x double, res int"), ["id"]).cache()
    oof = MD.cross_validate(folds, ["x"], K.DRAW_WEIGHT)
    assert oof.count() == 300
    assert oof.filter("abs(p_away + p_draw + p_home - 1) > 1e-9").count() == 0
    assert M.overall(oof).first()["accuracy"] > 0.6


def test_boosted_probabilities_sum_to_one(spark):
    rows = [(float(i % 10), float(i % 7), (i % 10 > 6) * 2 + (3 < i % 10 <= 6)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, res int")
    model = MD.fit_outcome(df, ["a", "b"], kind="boosted")
    out = MD.with_probabilities(model, df)
    assert out.filter("abs(p_away + p_draw + p_home - 1) > 1e-9").count() == 0


def test_run_log(spark, tmp_path):
    cols = "name string, timestamp_utc string, error string"
    runs = spark.createDataFrame([("a", "2026-01-01", None), ("a", "2026-01-02", "boom"), ("b", "2026-01-01", None)], cols)
    path = str(tmp_path / "runs")
    for r in (runs.filter("name = 'a'"), runs.filter("name = 'b'")):
        RN.append_run(r, path)
    read = RN.read_runs(spark, path)
    assert read.count() == 3 and RN.latest_run(read, "b").first()["timestamp_utc"] == "2026-01-01"
    with pytest.raises(Exception, match="boom"):
        RN.latest_run(read, "a").collect()
    with pytest.raises(Exception, match="no run named c"):
        RN.latest_run(read, "c").collect()


def test_experiment_end_to_end(spark, sf_dir, tmp_path):
    """Variant against baseline: features, folds, record, log, paired verdict."""
    from formline.catalog import tables as T
    from formline.plans.experiment import run_experiment

    matches = T.matches(spark, sf_dir)
    base, base_record = run_experiment("baseline", matches)
    variant, record = run_experiment("ewma", matches, variant="ewma_hl4", notes="n")
    path = str(tmp_path / "runs")
    RN.append_run(base_record, path)
    RN.append_run(record, path)
    last = RN.latest_run(RN.read_runs(spark, path), "ewma").first()
    n = matches.count()
    assert last["config"]["n_features"] == 30 and last["aggregate"]["oof_n"] == 5 * (n // 6) == base.count()
    assert [f["fold"] for f in last["folds"]] == [1, 2, 3, 4, 5]
    assert last["folds"][0]["train_n"] == n - 5 * (n // 6)
    assert last["aggregate"]["mean_log_loss"] == pytest.approx(
        np.mean([r["log_loss"] for r in M.overall(variant, "fold").collect()]))
    out = C.with_verdict(C.bootstrap_ci(C.paired(base, variant), 1000)).collect()
    assert {r["measure"] for r in out} == {"ll_delta", "brier_delta"} and all(r["ci_low"] <= r["mean_delta"] <= r["ci_high"] for r in out)
    assert M.leaderboard(RN.read_runs(spark, path)).count() == 2


def test_poisson_fit_settles_from_a_bad_start_and_reports_when_it_does_not(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 3, 800)
    y = rng.poisson(np.exp(np.clip(0.9 * x - 1, None, 8)))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    beta = MD.fit_poisson(df, [(["x"], "y")], 0.01)[0].beta
    mu = np.exp(beta[0] + beta[1] * x)
    assert abs(np.mean(mu - y)) < 1e-6 and abs(np.mean((mu - y) * x) + 0.01 * beta[1]) < 1e-6
    with pytest.raises(RuntimeError, match="did not settle"):
        MD.fit_poisson(df, [(["x"], "y")], 0.01, max_iter=2)


def test_cross_validation_without_tested_rows(spark):
    folds = spark.createDataFrame([(0, 0, 1, 1.0)], "pos long, fold int, res int, x double")
    assert MD.cross_validate(folds, ["x"]).count() == 0


def test_folds_of_placed_rows_are_those_of_sorted_rows(spark):
    rows = spark.range(103).selectExpr("(id * 37) % 103 AS k", "IF(id % 10 = 3, NULL, id) AS x")
    placed = rows.withColumn("ordinal", F.col("k"))
    for kept in (placed, placed.dropna(subset=["x"])):
        want = {tuple(r) for r in SP.time_series_folds(kept.drop("ordinal"), ["k"]).select("k", "pos", "fold").collect()}
        got = SP.placed_folds(placed, kept, ["k"])
        assert {tuple(r) for r in got.select("k", "pos", "fold").collect()} == want and "ordinal" not in got.columns

"""Known values of the probability kernels."""

import math

import pytest
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import scores as S


def one(df):
    return df.first().asDict()


def test_pmf(spark):
    got = spark.range(1).select(S.pmf(1, F.lit(1.5)).alias("p")).first()[0]
    assert got == pytest.approx(0.3346952401873944, abs=1e-10)


def test_outcome(spark):
    got = one(S.with_outcome(spark.createDataFrame([(1.5, 1.2)], "xG_home double, xG_away double")))
    assert got["Poisson_Home_Win"] == pytest.approx(0.4404416046877295, abs=1e-10)
    assert got["Poisson_Draw"] == pytest.approx(0.2800552896584424, abs=1e-10)
    assert got["Poisson_Away_Win"] == pytest.approx(0.2795031056538281, abs=1e-10)


def test_feature_bundle(spark):
    cols = ["Home_Elo", "Away_Elo", "Home_Avg_GF", "Away_Avg_GF", "Home_Avg_GA", "Away_Avg_GA"]
    row = spark.createDataFrame([(1500.0, 1500.0, 1.3, 1.3, 1.0, 1.0)], cols)
    got = one(S.with_poisson_features(row))
    want = {"xG_home": 1.33975, "xG_away": 1.165, "xG_diff": 0.17475, "Poisson_Home_Win": 0.4067938056455006,
            "Poisson_Draw": 0.29507625648770097, "Poisson_Away_Win": 0.2981299378667985,
            "Expected_Home_Goals": 1.3396596657675306, "Expected_Away_Goals": 1.1649694183156658,
            "Expected_Total_Goals": 2.5046290840831964}
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-10), name


@pytest.mark.parametrize("rates", [(0.0, 0.0), (0.0, 10.0), (10.0, 0.0), (10.0, 10.0), (1e-9, 2.0)])
def test_extreme_rates_stay_probabilities(spark, rates):
    got = one(S.with_outcome(spark.createDataFrame([rates], "xG_home double, xG_away double")))
    triple = [got["Poisson_Home_Win"], got["Poisson_Draw"], got["Poisson_Away_Win"]]
    assert all(math.isfinite(p) and 0 <= p <= 1 for p in triple)
    assert sum(triple) == pytest.approx(1.0, abs=0.01)


def test_null_rate_gives_null(spark):
    got = one(S.with_outcome(spark.createDataFrame([(None, 1.0)], "xG_home double, xG_away double")))
    assert got["Poisson_Draw"] is None and got["Expected_Home_Goals"] is None


def test_shin(spark):
    odds = "odds_h double, odds_d double, odds_a double"
    rows = [(3.0, 3.0, 3.0), (2.0, 3.2, 3.6), (None, 3.2, 3.6), (0.0, 3.0, 3.0), (4.0, 4.0, 4.0), (1.01, 1.01, 1.01)]
    got = S.with_shin(spark.createDataFrame(rows, odds)).collect()
    for r in (got[0], got[2], got[3], got[4], got[5]):
        assert r["Shin_Prob_H"] == pytest.approx(1 / 3, abs=1e-9)
    assert got[1]["shin_z"] == pytest.approx(0.12646, abs=1e-5)
    assert sum(got[1][f"Shin_Prob_{x}"] for x in "HDA") == pytest.approx(1.0, abs=1e-10)
    default = S.with_shin(spark.createDataFrame([(None, 3.2, 3.6)], odds), missing=(0.333, 0.333, 0.334)).first()
    assert default["Shin_Prob_A"] == 0.334


def test_shin_extreme_market_uses_more_steps(spark):
    pis = (0.93, 0.35, 0.05)
    row = spark.createDataFrame([tuple(1 / p for p in pis)], "odds_h double, odds_d double, odds_a double")
    got = S.with_shin(row).first()
    low, high = 0.0, 1 - 1e-10
    for _ in range(100):
        z = (low + high) / 2
        total = sum(((math.sqrt(z * z + 4 * (1 - z) * p) - z) / (2 * (1 - z))) ** 2 for p in pis)
        low, high = (z, high) if total > 1 else (low, z)
    assert got["shin_z"] == pytest.approx(low, abs=1e-8)


def brute_grid(lh, la, factor, floor=None):
    cells = {(i, j): math.exp(-lh - la) * lh ** i / math.factorial(i) * la ** j / math.factorial(j) * factor(i, j)
             for i in range(9) for j in range(9)}
    if floor is not None:
        cells = {k: max(v, floor) for k, v in cells.items()}
    total = sum(cells.values())
    return {k: v / total for k, v in cells.items()}


def tau(i, j, lh, la, rho):
    return {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): 1 - rho}.get((i, j), 1.0)


@pytest.mark.parametrize("lh,la,rho", [(1.4, 1.1, 0.1), (0.5, 2.4, -0.2), (3.0, 0.2, 0.25)])
def test_score_grids(spark, lh, la, rho):
    df = spark.createDataFrame([(lh, la)], "h double, a double")
    grid = brute_grid(lh, la, lambda i, j: tau(i, j, lh, la, rho))
    got = S.with_dc_grid(df, "h", "a", rho).first()
    assert got["p_home"] == pytest.approx(sum(v for (i, j), v in grid.items() if i > j), abs=1e-12)
    assert got["p_draw"] == pytest.approx(sum(v for (i, j), v in grid.items() if i == j), abs=1e-12)
    diag = brute_grid(lh, la, lambda i, j: 1 - 2 * 0.14 if i == j else 1.14)
    got = S.with_diagonal_grid(df, "h", "a").first()
    assert got["p_away"] == pytest.approx(sum(v for (i, j), v in diag.items() if i < j), abs=1e-12)


def test_score_matrix_with_negative_cells(spark):
    df = spark.createDataFrame([(4.0, 4.0)], "h double, a double")
    got = S.with_dc_grid(df, "h", "a", 0.2, 0.1, goals=("eh", "ea"), matrix="m").first()
    grid = brute_grid(4.0, 4.0, lambda i, j: tau(i, j, 4.0, 4.0, 0.2), floor=0.0)
    assert got["m"] == pytest.approx([grid[i, j] for i in range(9) for j in range(9)], abs=1e-12)
    assert got["eh"] == pytest.approx(sum(i * v for (i, j), v in grid.items()), abs=1e-12)


def test_elo_update_and_bounds(spark):
    df = spark.createDataFrame([(1500.0, 1500.0, 2), (2799.0, 2799.0, 2), (801.0, 801.0, 2)], "h double, a double, r int")
    home, away = S.updated_elo(F.col("h"), F.col("a"), F.col("r"))
    got = df.select(home.alias("h"), away.alias("a")).collect()
    exp = 1 / (1 + 10 ** (-65 / 400))
    assert got[0]["h"] == pytest.approx(1500 + 30 * (1 - exp)) and got[0]["a"] == pytest.approx(1500 - 30 * (1 - exp))
    assert got[1]["h"] == 2800.0 and got[2]["a"] == 800.0


def reference_scoreline(eh, ea, pred, ph, pd, pa):
    h, a = math.floor(max(eh, 0)), math.floor(max(ea, 0))
    if max(ph, pd, pa) >= 0.35:
        if pred == 2 and ph == max(ph, pd, pa):
            h = a + 1 if h <= a else min(6, h + 1) if ph >= 0.5 else h
        elif pred == 0 and pa == max(ph, pd, pa):
            a = h + 1 if a <= h else min(6, a + 1) if pa >= 0.5 else a
        elif pred == 1 and pd == max(ph, pd, pa):
            h = a = max(h, a)
    return min(6, max(0, h)), min(6, max(0, a))


def test_scoreline(spark):
    rows = [(1.4, 1.2, 2, .5, .3, .2), (2.4, 1.2, 2, .5, .3, .2), (0.4, 1.2, 0, .2, .3, .5), (0.4, 2.2, 1, .2, .5, .3),
            (7.9, 8.9, 0, .1, .1, .8), (1.9, 0.2, 2, .34, .33, .33), (1.5, 1.5, 1, .4, .2, .4)]
    df = spark.createDataFrame(rows, "eh double, ea double, pred int, ph double, pd double, pa double")
    got = S.with_scoreline(df, "eh", "ea", "pred", "ph", "pd", "pa").collect()
    for r, g in zip(rows, got):
        assert (g["Pred_Home_Goals"], g["Pred_Away_Goals"]) == reference_scoreline(*r), r


def test_pick_market_blend_shrink(spark):
    df = spark.createDataFrame([(.4, .2, .4), (.2, .5, .3), (.1, .3, .6), (.36, .34, .3)], "h double, d double, a double")
    picks = [r[0] for r in df.select(S.top_pick(F.col("h"), F.col("d"), F.col("a"))).collect()]
    assert picks == ["Home (Marginal)", "Draw (Moderate)", "Away (Strong)", "Home (Marginal)"]
    third = F.lit(1 / 3)
    row = spark.range(1).select(
        S.market_text(third, third, third).alias("none"), S.market_text(F.lit(None).cast("double"), third, third).alias("gap"),
        S.market_text(F.lit(.5), F.lit(.3125), F.lit(.2)).alias("some"),
        S.blended(F.lit(.2), F.lit(.3)).alias("blend"), S.shrunk(F.lit(2.0), F.lit(-3)).alias("cold"),
        S.shrunk(F.lit(2.0), F.lit(5)).alias("warm"), S.expected_value(F.lit(.5), F.lit(2.2)).alias("ev")).first()
    assert row["none"] == row["gap"] == "[Not available]"
    assert row["some"] == "P(Away): 20.0% | P(Draw): 31.2% | P(Home): 50.0%"
    assert row["blend"] == pytest.approx(.24) and row["ev"] == pytest.approx(.1)
    assert row["cold"] == pytest.approx(1.15) and row["warm"] == pytest.approx(1.575)


def test_constants():
    assert (K.BASE_ELO, K.K_FACTOR, K.HOME_ADVANTAGE, K.BASE_GOAL_RATE, K.MAX_GOALS) == (1500, 30, 65, 1.11, 8)
    assert (K.DRAW_ADJUSTMENT, K.HOME_ADVANTAGE_BOOST, K.BLEND_RATIO) == (1.11, 0.02, 0.6)
    assert len(K.FEATURE_COLUMNS) == 24

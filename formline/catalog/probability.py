"""Queries on rating, goal and outcome probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.catalog import tables as T
from formline.catalog.form import batched, rounded
from formline.catalog.registry import query
from formline.catalog.sql import CTES, DEPENDS, expected, r, with_ctes
from formline.functions import scores as S
from formline.operators import models, windows as W
from formline.plans.features import build_features, goal_features

P = 8


def rated(spark, sf_dir) -> DataFrame:
    """Matches with a spread of ratings taken from their keys."""
    key = F.col("match_id")
    return T.matches(spark, sf_dir).withColumns({"elo_h": 1200.0 + key % 600, "elo_a": 1200.0 + key * 7 % 600})


CTES["rated"] = """
SELECT *, CAST(1200 + match_id % 600 AS DOUBLE) AS elo_h, CAST(1200 + match_id * 7 % 600 AS DOUBLE) AS elo_a FROM matches"""
DEPENDS["rated"] = ["matches"]


def flat(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """Matches (``rows``, if given) with imputed form, all teams at the base rating, and xG."""
    rows = W.impute_trailing(W.with_trailing(batched(spark, sf_dir) if rows is None else rows))
    rows = rows.withColumns({"Home_Elo": F.lit(K.BASE_ELO), "Away_Elo": F.lit(K.BASE_ELO)})
    home, away = S.expected_goals(*(F.col(c) for c in (
        "Home_Elo", "Away_Elo", "Home_Avg_GF", "Away_Avg_GF", "Home_Avg_GA", "Away_Avg_GA")))
    return rows.withColumns({"xG_home": home, "xG_away": away})


@query("prob_elo_expected", with_ctes(["rated"], f"""
SELECT match_id, {r(expected('elo_h', 'elo_a'), P)} AS home_score, {r(expected('elo_a', 'elo_h'), P)} AS away_score FROM rated"""))
def prob_elo_expected(spark, sf_dir):
    rows = rated(spark, sf_dir)
    rows = rows.withColumns({"h": S.expected_result(F.col("elo_h"), F.col("elo_a")),
                             "a": S.expected_result(F.col("elo_a"), F.col("elo_h"))})
    return rounded(rows, "match_id", digits=P, home_score="h", away_score="a")


_GAIN = f"30.0 * (res / 2.0 - {expected('elo_h + 65.0', 'elo_a')})"


@query("prob_elo_update", with_ctes(["rated"], f"""
SELECT match_id, {r(f'least(greatest(elo_h + {_GAIN}, 800.0), 2800.0)', P)} AS new_home,
       {r(f'least(greatest(elo_a - {_GAIN}, 800.0), 2800.0)', P)} AS new_away FROM rated"""))
def prob_elo_update(spark, sf_dir):
    home, away = S.updated_elo(F.col("elo_h"), F.col("elo_a"), F.col("res"))
    rows = rated(spark, sf_dir).withColumns({"h": home, "a": away})
    return rounded(rows, "match_id", digits=P, new_home="h", new_away="a")


@query("prob_xg", with_ctes(["flat_goals"], f"""
SELECT match_id, {r('xG_home', P)} AS xG_home, {r('xG_away', P)} AS xG_away FROM flat_goals"""))
def prob_xg(spark, sf_dir):
    return rounded(flat(spark, sf_dir), "match_id", digits=P, xG_home="xG_home", xG_away="xG_away")


@query("prob_pmf", with_ctes(["flat_goals"], f"""
SELECT match_id, {r('exp(-xG_home) * pow(xG_home, hg) / factorial(hg)', P)} AS p_home_goals,
       {r('exp(-xG_away) * pow(xG_away, ag) / factorial(ag)', P)} AS p_away_goals FROM flat_goals"""))
def prob_pmf(spark, sf_dir):
    def mass(goals, lam):
        return F.exp(-F.col(lam)) * F.pow(lam, goals) / F.factorial(goals)
    rows = flat(spark, sf_dir).withColumns({"h": mass("hg", "xG_home"), "a": mass("ag", "xG_away")})
    return rounded(rows, "match_id", digits=P, p_home_goals="h", p_away_goals="a")


_OUT = ["Poisson_Home_Win", "Poisson_Draw", "Poisson_Away_Win"]
_OUT_SQL = ", ".join(f"{r(c, P)} AS {c}" for c in _OUT)


@query("prob_outcome", with_ctes(["flat_outcome"], f"""
SELECT match_id, {_OUT_SQL}, {r('eh', P)} AS Expected_Home_Goals, {r('ea', P)} AS Expected_Away_Goals FROM flat_outcome"""))
def prob_outcome(spark, sf_dir):
    names = _OUT + ["Expected_Home_Goals", "Expected_Away_Goals"]
    return rounded(S.with_outcome(flat(spark, sf_dir)), "match_id", digits=P, **{n: n for n in names})


@query("top_picks", with_ctes(["flat_outcome"], f"""
SELECT match_id, league, season, home, away, {_OUT_SQL},
  CASE WHEN Poisson_Home_Win >= Poisson_Draw AND Poisson_Home_Win >= Poisson_Away_Win THEN 'Home'
       WHEN Poisson_Away_Win >= Poisson_Draw AND Poisson_Away_Win >= Poisson_Home_Win THEN 'Away' ELSE 'Draw' END || ' (' ||
  CASE WHEN greatest(Poisson_Home_Win, Poisson_Draw, Poisson_Away_Win) >= 0.55 THEN 'Strong'
       WHEN greatest(Poisson_Home_Win, Poisson_Draw, Poisson_Away_Win) >= 0.48 THEN 'Moderate' ELSE 'Marginal' END || ')' AS top_pick
FROM flat_outcome"""))
def top_picks(spark, sf_dir):
    """Form-based goal model, outcome probabilities and the pick of each match."""
    rows = S.with_outcome(flat(spark, sf_dir))
    rows = rows.withColumn("top_pick", S.top_pick(*(F.col(c) for c in _OUT)))
    return rounded(rows, "match_id", "league", "season", "home", "away", "top_pick", digits=P, **{n: n for n in _OUT})


_FEAT9 = {"xG_home": "xG_home", "xG_away": "xG_away", "xG_diff": "xG_home - xG_away",
          **{c: c for c in _OUT}, "Expected_Home_Goals": "eh", "Expected_Away_Goals": "ea", "Expected_Total_Goals": "eh + ea"}
_BALANCE = {"Elo_Diff": "Home_Elo - Away_Elo", "Attack_Balance": "Home_Avg_GF - Away_Avg_GF",
            "Def_Balance": "Away_Avg_GA - Home_Avg_GA", "Form_Balance": "Home_Form - Away_Form"}


@query("prob_features", with_ctes(["outcome"], "SELECT match_id, " + ", ".join(
    f"{r(e)} AS {n}" for n, e in _FEAT9.items()) + " FROM outcome"))
def prob_features(spark, sf_dir):
    return rounded(goal_features(T.matches(spark, sf_dir)), "match_id", **{n: n for n in _FEAT9})


@query("prob_balances", with_ctes(["form"], "SELECT match_id, " + ", ".join(
    f"{r(e)} AS {n}" for n, e in _BALANCE.items()) + " FROM form"))
def prob_balances(spark, sf_dir):
    return rounded(goal_features(T.matches(spark, sf_dir)), "match_id", **{n: n for n in _BALANCE})


ALL24 = {c: c for c in K.FEATURE_COLUMNS} | _FEAT9 | _BALANCE


@query("features", with_ctes(["outcome", "shin"], "SELECT match_id, " + ", ".join(
    f"{r(e)} AS {n}" for n, e in ALL24.items()) + """
FROM outcome JOIN (SELECT match_id, Shin_Prob_H, Shin_Prob_D, Shin_Prob_A FROM shin) USING (match_id)"""))
def features(spark, sf_dir):
    """The full 24-column model frame."""
    return rounded(build_features(T.matches(spark, sf_dir)), "match_id", **{n: n for n in K.FEATURE_COLUMNS})


_SHIN = ", ".join(f"{r(f'Shin_Prob_{x}', 7)} AS Shin_Prob_{x}" for x in "HDA")


@query("prob_shin", with_ctes(["shin"], f"SELECT match_id, {_SHIN}, {r('CASE WHEN ok THEN coalesce(z, 0) ELSE 0 END')} AS shin_z FROM shin"))
def prob_shin(spark, sf_dir):
    out = S.with_shin(T.matches(spark, sf_dir))
    return out.select("match_id", *[F.round(f"Shin_Prob_{x}", 7).alias(f"Shin_Prob_{x}") for x in "HDA"],
                      F.round("shin_z", 6).alias("shin_z"))


@query("prob_shin_cols", with_ctes(["shin"], f"SELECT match_id, {_SHIN} FROM shin"))
def prob_shin_cols(spark, sf_dir):
    names = [f"Shin_Prob_{x}" for x in "HDA"]
    return rounded(S.with_shin(T.matches(spark, sf_dir)), "match_id", digits=7, **{n: n for n in names})


@query("prob_shrink", with_ctes(["flat_goals"], f"""
SELECT match_id, {r('(xG_home * hg + 1.15 * 5) / (hg + 5)', 12)} AS shrunk_home,
       {r('(xG_away * ag + 1.15 * 5) / (ag + 5)', 12)} AS shrunk_away FROM flat_goals"""))
def prob_shrink(spark, sf_dir):
    rows = flat(spark, sf_dir).withColumns({"h": S.shrunk(F.col("xG_home"), F.col("hg")),
                                            "a": S.shrunk(F.col("xG_away"), F.col("ag"))})
    return rounded(rows, "match_id", digits=12, shrunk_home="h", shrunk_away="a")


def tau_sql(h: str, a: str, lh: str, la: str, rho: str) -> str:
    return (f"(CASE WHEN {h} = 0 AND {a} = 0 THEN 1 - {lh} * {la} * ({rho}) WHEN {h} = 1 AND {a} = 0 THEN 1 + {la} * ({rho}) "
            f"WHEN {h} = 0 AND {a} = 1 THEN 1 + {lh} * ({rho}) WHEN {h} = 1 AND {a} = 1 THEN 1 - ({rho}) ELSE 1 END)")


@query("prob_dc_tau", with_ctes(["flat_goals"], f"""
SELECT match_id, {r(tau_sql('hg', 'ag', 'xG_home', 'xG_away', '0.1') + ' + 1e-9', 7)} AS tau FROM flat_goals"""))
def prob_dc_tau(spark, sf_dir):
    """Low-score factors. They are short decimals, so both sides are shifted by
    1e-9 before rounding: a tie must not hang on the last bit."""
    rows = flat(spark, sf_dir)
    tau = S.dc_tau(F.col("hg"), F.col("ag"), F.col("xG_home"), F.col("xG_away"), F.lit(0.1))
    return rounded(rows.withColumn("t", tau + 1e-9), "match_id", digits=7, tau="t")


def cells_sql(source: str, lh: str, la: str, factor: str, floor: str) -> str:
    """Long form of the score grid: one row per match and cell."""
    return f"""
SELECT match_id, i, j, p / sum(p) OVER (PARTITION BY match_id) AS p FROM (
  SELECT match_id, i, j, greatest({floor}, exp(-lh) * pow(lh, i) / factorial(i) * exp(-la) * pow(la, j) / factorial(j) * {factor}) AS p
  FROM (SELECT match_id, {lh} AS lh, {la} AS la FROM {source}),
       (SELECT CAST(range AS INTEGER) AS i FROM range(9)), (SELECT CAST(range AS INTEGER) AS j FROM range(9)))"""


_CLASS = f"""{r('sum(CASE WHEN i < j THEN p ELSE 0 END)', P)} AS p_away, {r('sum(CASE WHEN i = j THEN p ELSE 0 END)', P)} AS p_draw,
 {r('sum(CASE WHEN i > j THEN p ELSE 0 END)', P)} AS p_home"""


@query("prob_dc_grid", with_ctes(["flat_goals"], f"SELECT match_id, {_CLASS} FROM cells GROUP BY match_id", {
    "cells": cells_sql("flat_goals", "greatest(xG_home, 1e-6)", "greatest(xG_away, 1e-6)", tau_sql("i", "j", "lh", "la", "0.1"), "-1")}))
def prob_dc_grid(spark, sf_dir):
    out = S.with_dc_grid(flat(spark, sf_dir), "xG_home", "xG_away", 0.1)
    return rounded(out, "match_id", digits=P, p_away="p_away", p_draw="p_draw", p_home="p_home")


@query("prob_diag_grid", with_ctes(["flat_goals"], f"SELECT match_id, {_CLASS} FROM cells GROUP BY match_id", {
    "cells": cells_sql("flat_goals", "xG_home", "xG_away", "(CASE WHEN i = j THEN 1 - 2 * 0.14 ELSE 1 + 0.14 END)", "-1")}))
def prob_diag_grid(spark, sf_dir):
    out = S.with_diagonal_grid(flat(spark, sf_dir), "xG_home", "xG_away")
    return rounded(out, "match_id", digits=P, p_away="p_away", p_draw="p_draw", p_home="p_home")


@query("prob_biv_dist", with_ctes(["flat_goals"], f"""
SELECT match_id, {_CLASS}, {r('sum(i * p)', P)} AS expected_h_goals, {r('sum(j * p)', P)} AS expected_a_goals,
       {r('max(p)', P)} AS top_cell, {r('max(CASE WHEN i = 2 AND j = 1 THEN p END)', P)} AS cell_2_1 FROM cells GROUP BY match_id""", {
    "cells": cells_sql("flat_goals", "greatest(0.1, xG_home)", "greatest(0.1, xG_away)", tau_sql("i", "j", "lh", "la", "-0.06"), "0")}))
def prob_biv_dist(spark, sf_dir):
    out = S.with_dc_grid(flat(spark, sf_dir), "xG_home", "xG_away", K.BIVARIATE_RHO, 0.1,
                         goals=("expected_h_goals", "expected_a_goals"), matrix="score_matrix")
    out = out.withColumns({"t": F.array_max("score_matrix"), "c21": F.col("score_matrix")[2 * 9 + 1]})
    names = ["p_away", "p_draw", "p_home", "expected_h_goals", "expected_a_goals"]
    return rounded(out, "match_id", digits=P, top_cell="t", cell_2_1="c21", **{n: n for n in names})


CTES["biv"] = """
SELECT r.match_id, elo_h + 65.0 - elo_a AS gap, least(greatest((r.match_id % 2000) / 1500.0 * 0.08, 0.0), 0.15) AS tax,
       coalesce(h.gf, 1.11) AS hgf, coalesce(h.ga, 1.11) AS hga, coalesce(a.gf, 1.11) AS agf, coalesce(a.ga, 1.11) AS aga
FROM rated r JOIN venue h ON h.match_id = r.match_id AND h.is_home JOIN venue a ON a.match_id = r.match_id AND NOT a.is_home"""
DEPENDS["biv"] = ["rated", "venue"]


CTES["bivl"] = f"""
SELECT match_id, gap, tax, exp(0.15 + 0.0012 * gap + 0.45 * ln(greatest(0.2, hgf)) + 0.35 * ln(greatest(0.2, aga))) AS lam_h,
  exp(-0.10 - 0.0012 * gap + 0.45 * ln(greatest(0.2, agf)) + 0.35 * ln(greatest(0.2, hga)) - tax) AS lam_a FROM biv"""
DEPENDS["bivl"] = ["biv"]


@query("prob_biv_lambda", with_ctes(["bivl"], f"""
SELECT b.match_id, 1200.0 + b.match_id % 600 AS home_elo, 1200.0 + b.match_id * 7 % 600 AS away_elo, {r('gap', P)} AS elo_diff, {r('tax', P)} AS travel_penalty,
  {r('lam_h', P)} AS lambda_home, {r('lam_a', P)} AS lambda_away, c.* EXCLUDE (match_id) FROM bivl b JOIN (
    SELECT match_id, {_CLASS}, {r('sum(i * p)', P)} AS expected_home_goals, {r('sum(j * p)', P)} AS expected_away_goals FROM cells GROUP BY match_id) c
  ON c.match_id = b.match_id""", {
    "cells": cells_sql("bivl", "greatest(0.1, lam_h)", "greatest(0.1, lam_a)", tau_sql("i", "j", "lh", "la", "-0.06"), "0")}))
def prob_biv_lambda(spark, sf_dir):
    """All eleven values of the bivariate model."""
    key = F.col("match_id")
    rows = W.with_venue(batched(spark, sf_dir)).fillna(K.BASE_GOAL_RATE, [
        f"{s}_Venue_{k}" for s in ("Home", "Away") for k in ("GF", "GA")])
    rows = rows.withColumns({"elo_h": 1200.0 + key % 600, "elo_a": 1200.0 + key * 7 % 600})
    out = S.with_bivariate_features(rows, "elo_h", "elo_a", "Home_Venue_GF", "Home_Venue_GA", "Away_Venue_GF",
                                    "Away_Venue_GA", (key % 2000).cast("double"))
    return rounded(out, "match_id", digits=P, home_elo="Home_Elo", away_elo="Away_Elo", elo_diff="Elo_Diff", travel_penalty="Travel_Penalty",
                   lambda_home="Lambda_Home", lambda_away="Lambda_Away", p_home="Bivariate_P_Home", p_draw="Bivariate_P_Draw",
                   p_away="Bivariate_P_Away", expected_home_goals="Expected_Home_Goals", expected_away_goals="Expected_Away_Goals")


_PICK = """CASE WHEN ph >= pd AND ph >= pa THEN 2 WHEN pa >= pd AND pa >= ph THEN 0 ELSE 1 END"""
_P3 = "SELECT * EXCLUDE (ph, pa), Poisson_Home_Win AS ph, Poisson_Draw AS pd, Poisson_Away_Win AS pa FROM flat_outcome"
_SCORELINE = f"""
SELECT *, CASE WHEN mx >= 0.35 AND pred = 2 THEN CASE WHEN mh <= ma THEN ma + 1 WHEN ph >= 0.5 THEN least(6, mh + 1) ELSE mh END
               WHEN mx >= 0.35 AND pred = 1 THEN greatest(mh, ma) ELSE mh END AS sh,
          CASE WHEN mx >= 0.35 AND pred = 0 THEN CASE WHEN ma <= mh THEN mh + 1 WHEN pa >= 0.5 THEN least(6, ma + 1) ELSE ma END
               WHEN mx >= 0.35 AND pred = 1 THEN greatest(mh, ma) ELSE ma END AS sa
FROM (SELECT *, {_PICK} AS pred, greatest(ph, pd, pa) AS mx, CAST(floor(greatest(0, eh)) AS INTEGER) AS mh,
             CAST(floor(greatest(0, ea)) AS INTEGER) AS ma FROM p3)"""


def _picked(spark, sf_dir) -> DataFrame:
    rows = S.with_outcome(flat(spark, sf_dir))
    pick = S.top_pick(*(F.col(c) for c in _OUT))
    rows = rows.withColumn("pred", F.when(pick.startswith("Home"), 2).when(pick.startswith("Away"), 0).otherwise(1))
    return S.with_scoreline(rows, "Expected_Home_Goals", "Expected_Away_Goals", "pred", *_OUT)


@query("prob_scoreline", with_ctes(["flat_outcome"], """
SELECT match_id, CAST(least(greatest(sh, 0), 6) AS INTEGER) AS pred_home_goals, CAST(least(greatest(sa, 0), 6) AS INTEGER) AS pred_away_goals
FROM s""", {"p3": _P3, "s": _SCORELINE}))
def prob_scoreline(spark, sf_dir):
    return _picked(spark, sf_dir).select("match_id", F.col("Pred_Home_Goals").alias("pred_home_goals"),
                                         F.col("Pred_Away_Goals").alias("pred_away_goals"))


@query("prob_label", with_ctes(["flat_outcome"], """
SELECT match_id, CASE WHEN sh > sa THEN 'Home Win' WHEN sh < sa THEN 'Away Win' ELSE 'Draw' END AS label FROM s""",
       {"p3": _P3, "s": _SCORELINE}))
def prob_label(spark, sf_dir):
    return _picked(spark, sf_dir).select(
        "match_id", S.score_label(F.col("Pred_Home_Goals"), F.col("Pred_Away_Goals")).alias("label"))


_CONF = "CASE WHEN mx >= 0.55 THEN 'Strong' WHEN mx >= 0.48 THEN 'Moderate' ELSE 'Marginal' END"


@query("prob_pick", with_ctes(["shin"], f"""
SELECT match_id, CASE {_PICK} WHEN 2 THEN 'Home' WHEN 0 THEN 'Away' ELSE 'Draw' END || ' (' || {_CONF} || ')' AS top_pick
FROM (SELECT *, greatest(ph, pd, pa) AS mx FROM p)""", {
    "p": "SELECT match_id, Shin_Prob_H AS ph, Shin_Prob_D AS pd, Shin_Prob_A AS pa FROM shin"}))
def prob_pick(spark, sf_dir):
    rows = S.with_shin(T.matches(spark, sf_dir))
    return rows.select("match_id", S.top_pick(*(F.col(f"Shin_Prob_{x}") for x in "HDA")).alias("top_pick"))


@query("prob_market", with_ctes(["shin"], """
SELECT match_id, CASE WHEN abs(Shin_Prob_H - 1.0 / 3) < 1e-4 AND abs(Shin_Prob_A - 1.0 / 3) < 1e-4 THEN '[Not available]'
  ELSE printf('P(Away): %.1f%% | P(Draw): %.1f%% | P(Home): %.1f%%', Shin_Prob_A * 100, Shin_Prob_D * 100, Shin_Prob_H * 100) END AS market
FROM shin"""))
def prob_market(spark, sf_dir):
    rows = S.with_shin(T.matches(spark, sf_dir))
    return rows.select("match_id", S.market_text(*(F.col(f"Shin_Prob_{x}") for x in "HDA")).alias("market"))


@query("prob_ev", with_ctes(["flat_outcome"], "SELECT match_id, " + ", ".join(
    f"{r(f'{p} * {o} - 1', P)} AS ev_{n}" for p, o, n in (
        ("Poisson_Home_Win", "odds_h", "home"), ("Poisson_Draw", "odds_d", "draw"), ("Poisson_Away_Win", "odds_a", "away")))
    + " FROM flat_outcome"))
def prob_ev(spark, sf_dir):
    rows = S.with_outcome(flat(spark, sf_dir))
    rows = rows.withColumns({f"_{o}": S.expected_value(F.col(p), F.col(o)) for p, o in zip(_OUT, ("odds_h", "odds_d", "odds_a"))})
    return rounded(rows, "match_id", digits=P, ev_home="_odds_h", ev_draw="_odds_d", ev_away="_odds_a")


@query("prob_blend", with_ctes(["flat_outcome", "shin"], "SELECT match_id, " + ", ".join(
    f"{r(f'0.6 * s.Shin_Prob_{x} + 0.4 * o.{p}', 7)} AS blend_{n}" for x, p, n in (
        ("H", "Poisson_Home_Win", "home"), ("D", "Poisson_Draw", "draw"), ("A", "Poisson_Away_Win", "away")))
    + " FROM flat_outcome o JOIN shin s USING (match_id)"))
def prob_blend(spark, sf_dir):
    rows = S.with_shin(S.with_outcome(flat(spark, sf_dir)))
    rows = rows.withColumns({f"_{x}": S.blended(F.col(f"Shin_Prob_{x}"), F.col(p)) for x, p in zip("HDA", _OUT)})
    return rounded(rows, "match_id", digits=7, blend_home="_H", blend_draw="_D", blend_away="_A")


@query("prob_encode", with_ctes(["matches"], """
SELECT match_id, CASE res WHEN 2 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS code, res AS encoded,
       CASE res WHEN 2 THEN 'Home Win' WHEN 1 THEN 'Draw' ELSE 'Away Win' END AS label FROM matches"""))
def prob_encode(spark, sf_dir):
    code = F.when(F.col("hg") > F.col("ag"), "H").when(F.col("hg") == F.col("ag"), "D").otherwise("A")
    rows = T.matches(spark, sf_dir).withColumn("code", code)
    rows = rows.withColumn("encoded", S.encode_result(F.col("code")))
    return rows.select("match_id", "code", "encoded", S.decode_result(F.col("encoded")).alias("label"))


DRAW_GRID = [0.85, 0.95, 1.0, 1.05, 1.11, 1.2, 1.3]
BOOST_GRID = [0.0, 0.01, 0.02, 0.03, 0.05]


@query("prob_calibrate", with_ctes(["flat_grid"], f"""
SELECT draw_factor, home_boost, {r('hs')} AS home_share, {r('1 - hs - aws')} AS draw_share, {r('aws')} AS away_share,
       {r('abs(hs - o2) + abs(1 - hs - aws - o1) + abs(aws - o0)')} AS distance FROM (
  SELECT draw_factor, home_boost, avg(qh / (qh + qa + d * draw_factor)) AS hs, avg(qa / (qh + qa + d * draw_factor)) AS aws,
         avg(CASE WHEN res = 0 THEN 1.0 ELSE 0.0 END) AS o0, avg(CASE WHEN res = 1 THEN 1.0 ELSE 0.0 END) AS o1,
         avg(CASE WHEN res = 2 THEN 1.0 ELSE 0.0 END) AS o2
  FROM (SELECT res, d, draw_factor, home_boost, least(greatest(w / (w + l) * (1 - d * draw_factor) + home_boost, 0), 1) AS qh,
               least(greatest(l / (w + l) * (1 - d * draw_factor) - home_boost / 2, 0), 1) AS qa
        FROM flat_grid, (SELECT CAST(unnest({DRAW_GRID}) AS DOUBLE) AS draw_factor), (SELECT CAST(unnest({BOOST_GRID}) AS DOUBLE) AS home_boost))
  GROUP BY draw_factor, home_boost)"""))
def prob_calibrate(spark, sf_dir):
    out = models.calibration(flat(spark, sf_dir), DRAW_GRID, BOOST_GRID)
    return rounded(out, "draw_factor", "home_boost", **{n: n for n in ("home_share", "draw_share", "away_share", "distance")})

"""Queries on splits, fits, scores and comparisons."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.catalog import tables as T
from formline.catalog.form import batched, rounded
from formline.catalog.probability import flat, tau_sql
from formline.catalog.registry import query
from formline.catalog.shared import elo_walk, feature_folds, feature_table, goal_folds, goal_oof
from formline.catalog.sql import CTES, DEPENDS, r, with_ctes
from formline.catalog.text import standings_rows
from formline.functions import scores as S
from formline.operators import compare as C, metrics as M, models as MD, splits as SP, windows as W
from formline.plans.experiment import compare_runs, logged_run, run_record
from formline.plans.training import train_production
from formline.plans.predict import fixture_features, predict_fixtures
from formline.session import materialize, new_path
from formline.sinks import reports as R, runs as RN

CTES["ordered"] = "SELECT *, row_number() OVER (ORDER BY batch_ts, match_id) - 1 AS pos, (SELECT count(*) FROM matches) AS n FROM batched"
CTES["folds"] = """
SELECT *, CASE WHEN pos >= n - 5 * (n // 6) THEN CAST((pos - (n - 5 * (n // 6))) // (n // 6) + 1 AS INTEGER) ELSE 0 END AS fold FROM ordered"""
CTES["gfolds"] = """
SELECT f.match_id, f.pos, f.fold, f.date, f.res AS y_true, f.odds_h, f.odds_d, f.odds_a, o.Poisson_Away_Win AS p_away, o.Poisson_Draw AS p_draw,
       o.Poisson_Home_Win AS p_home, o.xG_home, o.xG_away FROM folds f JOIN flat_outcome o USING (match_id)"""
_SCORED = """
SELECT *, CASE WHEN p_away >= p_draw AND p_away >= p_home THEN 0 WHEN p_draw >= p_home THEN 1 ELSE 2 END AS pred,
       -ln(greatest(CASE y_true WHEN 0 THEN p_away WHEN 1 THEN p_draw ELSE p_home END, 1e-15)) AS ll,
       pow(p_away - CASE WHEN y_true = 0 THEN 1 ELSE 0 END, 2) + pow(p_draw - CASE WHEN y_true = 1 THEN 1 ELSE 0 END, 2)
       + pow(p_home - CASE WHEN y_true = 2 THEN 1 ELSE 0 END, 2) AS br FROM """
CTES["scored"] = _SCORED + "gfolds"
CTES["oof"] = "SELECT * FROM scored WHERE fold >= 1"
DEPENDS |= {"ordered": ["batched"], "folds": ["ordered"], "gfolds": ["folds", "flat_outcome"], "scored": ["gfolds"], "oof": ["scored"]}


@query("cv_ts", with_ctes(["folds"], "SELECT match_id, pos, fold FROM folds"))
def cv_ts(spark, sf_dir):
    return SP.time_series_folds(batched(spark, sf_dir), ["batch_ts", "match_id"]).select("match_id", "pos", "fold")


_FOLD_OF = """CASE WHEN segment // greatest(1, s // least(5, greatest(2, s))) BETWEEN 1 AND least(5, greatest(2, s)) - 1
 THEN CAST(segment // greatest(1, s // least(5, greatest(2, s))) AS INTEGER) END AS fold"""


@query("cv_segments", with_ctes(["matches"], f"""
SELECT match_id, segment, {_FOLD_OF} FROM (SELECT *, max(segment) OVER () + 1 AS s FROM (
  SELECT m.match_id, g.segment FROM matches m JOIN seg g ON g.date = m.date AND g.season = m.season))""", {
    "seg": """SELECT date, season, CAST(sum(st) OVER (ORDER BY date, season) AS INTEGER) - 1 AS segment FROM (
      SELECT *, CASE WHEN lag(date) OVER o IS NULL OR date - lag(date) OVER o > 21 OR season <> lag(season) OVER o THEN 1 ELSE 0 END AS st
      FROM (SELECT DISTINCT date, season FROM matches) WINDOW o AS (ORDER BY date, season))"""}))
def cv_segments(spark, sf_dir):
    return SP.segment_folds(batched(spark, sf_dir), ["batch_ts", "match_id"]).select("match_id", "segment", "fold")


@query("cv_groups", with_ctes(["ordered"], f"""
SELECT match_id, segment, {_FOLD_OF} FROM (SELECT *, max(segment) OVER () + 1 AS s FROM (
  SELECT match_id, CAST(sum(ch) OVER (ORDER BY pos) AS INTEGER) - 1 AS segment FROM (
    SELECT match_id, pos, CASE WHEN lag(q) OVER (ORDER BY pos) IS NOT DISTINCT FROM q THEN 0 ELSE 1 END AS ch
    FROM (SELECT *, season || 'H' || CAST(month(date) > 6 AS INTEGER) AS q FROM ordered))))"""))
def cv_groups(spark, sf_dir):
    half = F.concat("season", F.lit("H"), (F.month("date") > 6).cast("int"))
    rows = batched(spark, sf_dir).withColumn("half", half)
    return SP.group_folds(rows, ["batch_ts", "match_id"], "half").select("match_id", "segment", "fold")


@query("cv_early_stop", with_ctes(["folds"], """
SELECT f.fold, match_id, pos >= f.start - greatest(f.start // 10, 1) AS is_validation
FROM folds t JOIN (SELECT fold, min(pos) AS start FROM folds WHERE fold >= 1 GROUP BY fold) f ON t.pos < f.start"""))
def cv_early_stop(spark, sf_dir):
    """Training rows of every fold, the last tenth flagged. A row trains all
    later folds, so it is repeated at most once per fold."""
    folds = SP.time_series_folds(batched(spark, sf_dir), ["batch_ts", "match_id"]).select("match_id", "pos", F.col("fold").alias("own"))
    borders = SP.fold_borders(folds.withColumnRenamed("own", "fold")).select("fold", F.col("start").alias("n_train"))
    later = F.explode(F.when(F.col("own") < K.N_SPLITS, F.sequence(F.col("own") + 1, F.lit(K.N_SPLITS))))
    train = folds.withColumn("fold", later).join(borders, "fold")
    return SP.early_stop_flag(train, F.col("n_train")).select("fold", "match_id", "is_validation")


# --- fits -----------------------------------------------------------------------

def _oof_rounded(oof: DataFrame) -> DataFrame:
    return rounded(oof, "pos", "fold", "y_true", p_away="p_away", p_draw="p_draw", p_home="p_home")


_STARTS = "(SELECT fold, min(pos) AS start FROM folds WHERE fold >= 1 GROUP BY fold)"


@query("mdl_fit", with_ctes(["folds"], f"""
SELECT fold, res, n AS n_train, {r('k / n')} AS mean_probability, 0.0 AS worst_slope FROM (
  SELECT s.fold, c.res, count(*) AS n, count_if(t.res = c.res) AS k FROM {_STARTS} s JOIN folds t ON t.pos < s.start,
    (SELECT unnest([0, 1, 2]) AS res) c GROUP BY ALL)"""))
def mdl_fit(spark, sf_dir):
    """The fits of all folds at their optimum: no slope is left, and mean probabilities are the class shares."""
    fits, rows, parts = MD.fit_outcome_folds(feature_folds(spark, sf_dir), K.FEATURE_COLUMNS)
    return rounded(MD.outcome_report(rows, fits, parts), "fold", "res", "n_train", mean_probability="mean_probability", worst_slope="worst_slope")


@query("mdl_fit_oof")
def mdl_fit_oof(spark, sf_dir):
    """Out-of-fold probabilities of the 24-feature outcome model."""
    return _oof_rounded(MD.cross_validate(feature_folds(spark, sf_dir), K.FEATURE_COLUMNS))


_SEGMENTED = {
    "seg": """SELECT date, season, CAST(sum(st) OVER (ORDER BY date, season) AS INTEGER) - 1 AS segment FROM (
      SELECT *, CASE WHEN lag(date) OVER o IS NULL OR date - lag(date) OVER o > 21 OR season <> lag(season) OVER o THEN 1 ELSE 0 END AS st
      FROM (SELECT DISTINCT date, season FROM matches) WINDOW o AS (ORDER BY date, season))""",
    "sfolds": f"""SELECT pos, res, {_FOLD_OF} FROM (SELECT o.pos, o.res, g.segment, max(g.segment) OVER () + 1 AS s
      FROM ordered o JOIN seg g ON g.date = o.date AND g.season = o.season)"""}


@query("mdl_production", with_ctes(["ordered"], f"""
SELECT t.fold, start - greatest(start // 10, 1) AS n_train, greatest(start // 10, 1) AS n_held, n AS n_tested, NULL AS p_home
FROM (SELECT fold, min(pos) AS start, count(*) AS n FROM sfolds WHERE fold IS NOT NULL GROUP BY fold) t
UNION ALL SELECT NULL, count(*), 0, 0, {r('avg(CASE WHEN res = 2 THEN 1.0 ELSE 0.0 END)')} FROM sfolds""", _SEGMENTED))
def mdl_production(spark, sf_dir):
    """Rows that each fit of the production training saw; the final model's mean probability is the share of home wins."""
    rows = feature_table(spark, sf_dir)
    model, _, lines = train_production(rows, ["batch_ts", "match_id"])
    scored = model.with_probabilities(rows)
    last = scored.agg(F.lit(None).cast("int").alias("fold"), F.count(F.lit(1)).alias("n_train"), F.lit(0).cast("long").alias("n_held"),
                      F.lit(0).cast("long").alias("n_tested"), F.round(F.avg("p_home"), 6).alias("p_home"))
    return lines.select("fold", "n_train", "n_held", "n_tested", F.lit(None).cast("double").alias("p_home")).unionByName(last)


@query("mdl_production_scores")
def mdl_production_scores(spark, sf_dir):
    """Accuracy and log loss of the production training by fold."""
    _, _, lines = train_production(feature_table(spark, sf_dir), ["batch_ts", "match_id"])
    return rounded(lines, "fold", "n_tested", accuracy="accuracy", log_loss="log_loss")


@query("mdl_weights", with_ctes(["matches"], "SELECT match_id, res, CASE WHEN res = 1 THEN 0.7 ELSE 1.0 END AS w, 1.0 AS w_uniform FROM matches"))
def mdl_weights(spark, sf_dir):
    return T.matches(spark, sf_dir).select("match_id", "res", MD.class_weight(F.col("res")).alias("w"),
                                           MD.class_weight(F.col("res"), 1.0).alias("w_uniform"))


@query("mdl_importance")
def mdl_importance(spark, sf_dir):
    model = MD.fit_outcome(feature_folds(spark, sf_dir), K.FEATURE_COLUMNS, kind="forest")
    return MD.importances(model, K.FEATURE_COLUMNS, spark)


def _goal_optimum(side_sql: str) -> str:
    """Mean goals of all training rows; at the optimum they are the mean rates, and no slope is left."""
    return f"""SELECT goals, fold, n AS n_train, {r('g')} AS mean_goals, {r('g')} AS mean_rate, 0.0 AS worst_slope FROM ({side_sql})"""


_GOALS_ALL = _goal_optimum(" UNION ALL ".join(f"SELECT '{c}' AS goals, 1 AS fold, count(*) AS n, avg({c}) AS g FROM folds" for c in ("hg", "ag")))
_GOALS_BY_FOLD = _goal_optimum(" UNION ALL ".join(
    f"SELECT '{c}' AS goals, s.fold, count(*) AS n, avg(t.{c}) AS g FROM {_STARTS} s JOIN folds t ON t.pos < s.start GROUP BY s.fold" for c in ("hg", "ag")))


def _goal_report(folds: DataFrame, mode: str, final: bool = False) -> DataFrame:
    *_, rows, parts = MD.fit_goal_folds(folds, mode, final)
    return rounded(MD.goal_report(rows, parts, mode), "goals", "fold", "n_train", mean_goals="mean_goals", mean_rate="mean_rate",
                   worst_slope="worst_slope")


@query("mdl_poisson", with_ctes(["folds"], _GOALS_ALL))
def mdl_poisson(spark, sf_dir):
    """The home and away goal regressions of all rows, at their optimum."""
    return _goal_report(feature_folds(spark, sf_dir), "mixed", final=True)


@query("mdl_poisson_min", with_ctes(["folds"], _GOALS_ALL))
def mdl_poisson_min(spark, sf_dir):
    """The minimal regressions of all rows, at their optimum."""
    return _goal_report(MD.minimal_frame(feature_folds(spark, sf_dir)), "minimal", final=True)


@query("mdl_dc_cv_fits", with_ctes(["folds"], _GOALS_BY_FOLD))
def mdl_dc_cv_fits(spark, sf_dir):
    """The goal regressions of every fold, at their optimum."""
    return _goal_report(feature_folds(spark, sf_dir), "mixed")


@query("mdl_min_cv_fits", with_ctes(["folds"], _GOALS_BY_FOLD))
def mdl_min_cv_fits(spark, sf_dir):
    return _goal_report(MD.minimal_frame(feature_folds(spark, sf_dir)), "minimal")


@query("mdl_poisson_terms")
def mdl_poisson_terms(spark, sf_dir):
    """Coefficients of the home and away goal regressions."""
    fits = MD.fit_goal_models(feature_folds(spark, sf_dir), "mixed")
    rows = [(side, n, float(b)) for side, fit in zip(("home", "away"), fits)
            for n, b in zip(["intercept", *fit.features], fit.beta)]
    return spark.createDataFrame(rows, "side string, term string, coefficient double")


@query("mdl_poisson_min_rates")
def mdl_poisson_min_rates(spark, sf_dir):
    """Goal rates of all matches from the minimal regressions."""
    rows = MD.minimal_frame(feature_folds(spark, sf_dir))
    home, away = MD.fit_goal_models(rows, "minimal")
    return rounded(rows.withColumns({"h": home.rate(), "a": away.rate()}), "match_id", lambda_home="h", lambda_away="a")


def _rho_sql() -> str:
    """Narrowing grid search in SQL, one level per step."""
    ctes, prev = {"low": f"""SELECT exp(-xG_home - xG_away) * (CASE WHEN hg = 1 THEN xG_home ELSE 1 END) * (CASE WHEN ag = 1 THEN xG_away ELSE 1 END) AS p,
      {tau_sql('hg', 'ag', 'xG_home', 'xG_away', '1')} - 1 AS s FROM flat_goals WHERE hg <= 1 AND ag <= 1"""}, None
    for i, step in enumerate(MD.RHO_STEPS):
        span = f"(SELECT -0.3 + CAST(range AS DOUBLE) * {step} AS rho FROM range({round(0.6 / step) + 1}))" if prev is None else (
            f"(SELECT greatest(rho - {MD.RHO_STEPS[i - 1]}, -0.3) + CAST(range AS DOUBLE) * {step} AS rho FROM {prev}, range(21) "
            f"WHERE greatest(rho - {MD.RHO_STEPS[i - 1]}, -0.3) + range * {step} <= 0.3 + 1e-12)")
        ctes[f"g{i}"] = f"SELECT rho FROM (SELECT rho, sum(ln(greatest(p * (1 + s * rho), 1e-15))) AS l FROM low, {span} GROUP BY rho) ORDER BY l DESC LIMIT 1"
        prev = f"g{i}"
    return with_ctes(["flat_goals"], f"SELECT (SELECT count(*) FROM matches) AS n_matches, round(rho, 4) AS rho FROM {prev}", ctes)


@query("mdl_rho", _rho_sql())
def mdl_rho(spark, sf_dir):
    rows = materialize(flat(spark, sf_dir).select("xG_home", "xG_away", "hg", "ag"))
    rho = MD.estimate_rho(rows, "xG_home", "xG_away")[0]
    return rows.agg(F.count(F.lit(1)).alias("n_matches")).withColumn("rho", F.round(F.lit(rho), 4))


def _goal_cv(folds: DataFrame, mode: str) -> DataFrame:
    oof, rho = MD.goal_model_cv(folds, mode)
    oof = materialize(oof)
    out = M.overall(oof, "fold").join(M.draw_report(oof, "fold"), "fold").join(rho, "fold")
    return rounded(out, "fold", "n", "draw_pred", "draw_true", digits=5, rho="rho", accuracy="accuracy",
                   log_loss="log_loss", brier="brier", draw_recall="draw_recall")


@query("mdl_dc_cv")
def mdl_dc_cv(spark, sf_dir):
    """Two-stage goal model per fold: regressions, rho, three-class scores."""
    return _goal_cv(feature_folds(spark, sf_dir), "mixed")


@query("mdl_dc_cv_raw")
def mdl_dc_cv_raw(spark, sf_dir):
    """The same on venue-split attack and defence."""
    folds = feature_folds(spark, sf_dir)
    rows = W.attach_attack_defence(folds, W.venue_state(W.team_rows(batched(spark, sf_dir))))
    return _goal_cv(rows.fillna(K.BASE_GOAL_RATE, ["DC_Home_Att", "DC_Home_Def", "DC_Away_Att", "DC_Away_Def"]), "raw")


@query("mdl_min_cv")
def mdl_min_cv(spark, sf_dir):
    return _goal_cv(MD.minimal_frame(feature_folds(spark, sf_dir)), "minimal")


@query("mdl_eligible", with_ctes(["matches"], "SELECT match_id FROM matches"))
def mdl_eligible(spark, sf_dir):
    return feature_folds(spark, sf_dir).select("match_id")


_MEANS = {"Home_Avg_GF": "Home_Avg_GF", "Away_Avg_GA": "Away_Avg_GA", "Home_Form": "Home_Form", "Away_Form": "Away_Form",
          "xG_home": "xG_home", "Home_Elo": "Home_Elo", "Poisson_Draw": "Poisson_Draw", "Expected_Total_Goals": "eh + ea"}


@query("mdl_mean_fallback", with_ctes(["outcome"], "SELECT " + ", ".join(f"{r(f'avg({e})')} AS {n}" for n, e in _MEANS.items()) + " FROM outcome"))
def mdl_mean_fallback(spark, sf_dir):
    return rounded(MD.feature_means(feature_table(spark, sf_dir)), **{n: n for n in _MEANS})


def upcoming(spark, sf_dir) -> DataFrame:
    """Return fixtures of every pair met in the last season of a league."""
    rows = T.matches(spark, sf_dir)
    last = materialize(rows.groupBy("league").agg(F.max("season").alias("season")))  # a row per league, joined by its size
    pairs = rows.join(last, ["league", "season"], "left_semi")
    return pairs.groupBy("league", F.col("away").alias("HomeTeam"), F.col("home").alias("AwayTeam")).agg(
        F.max("odds_a").alias("odds_h"), F.max("odds_d").alias("odds_d"), F.max("odds_h").alias("odds_a"))


def _fixture_inputs(spark, sf_dir) -> DataFrame:
    rows = batched(spark, sf_dir)
    table = standings_rows(spark, sf_dir).groupBy("league", "team").agg(
        F.max("points").alias("points"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"))
    place = Window.partitionBy("league").orderBy(F.desc("points"), F.desc(F.col("goals_for") - F.col("goals_against")), F.desc("goals_for"), "team")
    table = table.withColumn("position", F.row_number().over(place))
    means = MD.feature_means(feature_table(spark, sf_dir)).first().asDict()
    return fixture_features(upcoming(spark, sf_dir), elo_walk(spark, sf_dir).final(), W.latest_state(rows), means, table)


@query("mdl_predict_fixtures")
def mdl_predict_fixtures(spark, sf_dir):
    """Scored fixtures: probabilities, scoreline and label."""
    model = MD.fit_outcome(feature_folds(spark, sf_dir), K.FEATURE_COLUMNS)
    out = predict_fixtures(_fixture_inputs(spark, sf_dir), model)
    return rounded(out, "league", "HomeTeam", "AwayTeam", "Prediction", "Pred_Home_Goals", "Pred_Away_Goals",
                   "Prediction_Label", **{c: c for c in ("Pred_Proba_Home", "Pred_Proba_Draw", "Pred_Proba_Away")})


CTES["fixed"] = """
SELECT m.league, m.away AS home, m.home AS away FROM matches m
JOIN (SELECT league, max(season) AS season FROM matches GROUP BY league) l ON l.league = m.league AND l.season = m.season GROUP BY ALL"""
CTES["last8"] = """
SELECT league, team, avg(gf) AS gf, avg(ga) AS ga, avg(pts) AS form FROM (
  SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY CAST(batch_ts AS DATE) DESC, batch_ts DESC, match_id DESC, is_home) AS n FROM long)
WHERE n <= 8 GROUP BY league, team"""
CTES["final_elo"] = """
SELECT p.league, p.team, f.acc.cur[t.no] AS elo FROM (SELECT DISTINCT league, team FROM long) p
JOIN teams t ON t.team = p.team JOIN elo_fold f ON f.league = p.league"""
CTES["fixture_goals"] = """
SELECT *, least(greatest((0.55 * hgf + 0.45 * aga) * 1.15 * (1 + (he - ae) / 5000.0), 0.3), 2.5) AS xh,
       least(greatest((0.55 * agf + 0.45 * hga) / (1 + (he - ae) / 5000.0), 0.3), 2.5) AS xa
FROM (SELECT f.*, eh.elo AS he, ea.elo AS ae, h.gf AS hgf, h.ga AS hga, a.gf AS agf, a.ga AS aga FROM fixed f
  JOIN last8 h ON h.league = f.league AND h.team = f.home JOIN last8 a ON a.league = f.league AND a.team = f.away
  JOIN final_elo eh ON eh.league = f.league AND eh.team = f.home JOIN final_elo ea ON ea.league = f.league AND ea.team = f.away)"""
DEPENDS |= {"fixed": ["matches"], "last8": ["long"], "final_elo": ["elo_fold"], "fixture_goals": ["fixed", "last8", "final_elo"]}


@query("mdl_shrunk_meta", with_ctes(["fixture_goals"], f"""
SELECT league, home AS "HomeTeam", away AS "AwayTeam", {r('xh')} AS xG_home, {r('xa')} AS xG_away, {r('he - ae')} AS Elo_Diff,
       {r('(xh + 1.15 * 5) / 6')} AS poisson_xg_home_meta, {r('(xa + 1.15 * 5) / 6')} AS poisson_xg_away_meta FROM fixture_goals"""))
def mdl_shrunk_meta(spark, sf_dir):
    """Fixture features up to the shrunk expected goals."""
    names = ["xG_home", "xG_away", "Elo_Diff", "poisson_xg_home_meta", "poisson_xg_away_meta"]
    return rounded(_fixture_inputs(spark, sf_dir), "league", "HomeTeam", "AwayTeam", **{n: n for n in names})


# --- scores -----------------------------------------------------------------------

@query("met_accuracy", with_ctes(["oof"], f"SELECT fold, count(*) AS n, {r('avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM oof GROUP BY fold"))
def met_accuracy(spark, sf_dir):
    return rounded(M.overall(goal_oof(spark, sf_dir), "fold"), "fold", "n", accuracy="accuracy")


@query("met_logloss", with_ctes(["oof"], f"SELECT {r('avg(ll)')} AS log_loss FROM oof"))
def met_logloss(spark, sf_dir):
    return rounded(M.overall(goal_oof(spark, sf_dir)), log_loss="log_loss")


@query("met_brier", with_ctes(["oof"], f"SELECT {r('avg(br)')} AS brier FROM oof"))
def met_brier(spark, sf_dir):
    return rounded(M.overall(goal_oof(spark, sf_dir)), brier="brier")


@query("met_confusion", with_ctes(["oof"], """
SELECT y AS y_true, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2
FROM (SELECT CAST(range AS INTEGER) AS y FROM range(3)) LEFT JOIN oof ON y_true = y GROUP BY y"""))
def met_confusion(spark, sf_dir):
    return M.confusion(goal_oof(spark, sf_dir))


_DRAW = f"""fold, count(*) FILTER (pred = 1) AS draw_pred, count(*) FILTER (y_true = 1) AS draw_true, count(*) FILTER (pred = 1 AND y_true = 1) AS draw_tp,
 {r('coalesce(count(*) FILTER (pred = 1 AND y_true = 1) / nullif(CAST(count(*) FILTER (y_true = 1) AS DOUBLE), 0), 0)')} AS draw_recall"""


@query("met_draw", with_ctes(["oof"], f"SELECT {_DRAW} FROM oof GROUP BY fold"))
def met_draw(spark, sf_dir):
    return rounded(M.draw_report(goal_oof(spark, sf_dir), "fold"), "fold", "draw_pred", "draw_true", "draw_tp", draw_recall="draw_recall")


@query("met_fold", with_ctes(["scored"], f"""
SELECT f.fold, f.val_n, f.accuracy, f.log_loss, f.val_from, f.val_to, f.first_pos, f.last_pos, count(*) AS train_n, min(s.date) AS train_from, max(s.date) AS train_to
FROM (SELECT fold, count(*) AS val_n, {r('avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r('avg(ll)')} AS log_loss,
             min(date) AS val_from, max(date) AS val_to, min(pos) AS first_pos, max(pos) AS last_pos FROM scored WHERE fold >= 1 GROUP BY fold) f
JOIN scored s ON s.pos < f.first_pos GROUP BY ALL"""))
def met_fold(spark, sf_dir):
    return rounded(M.per_fold(goal_folds(spark, sf_dir)), "fold", "val_n", "val_from", "val_to", "first_pos", "last_pos",
                   "train_n", "train_from", "train_to", accuracy="accuracy", log_loss="log_loss")


_SUMMARY = ["mean_accuracy", "std_accuracy", "mean_log_loss", "std_log_loss", "mean_brier", "oof_accuracy", "oof_log_loss", "brier_multiclass"]


@query("met_summary", with_ctes(["oof"], f"""
SELECT {r('avg(a)')} AS mean_accuracy, {r('stddev_pop(a)')} AS std_accuracy, {r('avg(l)')} AS mean_log_loss, {r('stddev_pop(l)')} AS std_log_loss,
  {r('avg(b)')} AS mean_brier, CAST(sum(n) AS BIGINT) AS oof_n, (SELECT {r('avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END)')} FROM oof) AS oof_accuracy,
  (SELECT {r('avg(ll)')} FROM oof) AS oof_log_loss, (SELECT {r('avg(br)')} FROM oof) AS brier_multiclass
FROM (SELECT fold, count(*) AS n, avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END) AS a, avg(ll) AS l, avg(br) AS b FROM oof GROUP BY fold)"""))
def met_summary(spark, sf_dir):
    return rounded(M.summary(goal_oof(spark, sf_dir)), "oof_n", **{n: n for n in _SUMMARY})


STAMP = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _records(spark, sf_dir) -> DataFrame:
    """Run records of the goal model, one of them failed, through JSON lines."""
    folds = goal_folds(spark, sf_dir)
    oof = folds.filter("fold >= 1")
    good = run_record("goals", oof, folds, 2, 1.0, "goal_model", stamp=STAMP)
    bad = good.withColumns({"name": F.lit("broken"), "error": F.lit("no data")})
    json = good.unionByName(bad).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    return json.select(F.from_json("j", M.RECORD).alias("r")).select("r.*")


@query("met_leaderboard", with_ctes(["oof"], """
SELECT 'goals' AS name, 2 AS n_features, count(*) AS oof_n, (SELECT string_agg(printf('%.4f', l), ' ' ORDER BY fold) FROM byfold) AS fold_log_loss,
       (SELECT string_agg(printf('%.4f', a), ' ' ORDER BY fold) FROM byfold) AS fold_accuracy, NULL AS failure,
       (SELECT round(avg(a), 4) FROM byfold) AS mean_accuracy, (SELECT round(avg(l), 4) FROM byfold) AS mean_log_loss FROM oof
UNION ALL SELECT 'broken', 2, NULL, NULL, NULL, 'broken: ERROR', NULL, NULL""", {
    "byfold": "SELECT fold, avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END) AS a, avg(ll) AS l FROM oof GROUP BY fold"}))
def met_leaderboard(spark, sf_dir):
    return M.leaderboard(_records(spark, sf_dir)).select(
        "name", "n_features", "oof_n", "fold_log_loss", "fold_accuracy", "failure", "mean_accuracy", "mean_log_loss")


def _variant(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Baseline and low-score corrected predictions of the same stored matches."""
    folds = goal_folds(spark, sf_dir).filter("fold >= 1")
    cols = ["pos", "fold", "y_true", "p_away", "p_draw", "p_home"]
    return folds.select(*cols), S.with_dc_grid(folds.drop("p_away", "p_draw", "p_home"), "xG_home", "xG_away", -0.06).select(*cols)


_DC = """SELECT o.pos, o.fold, o.y_true, g.p_away, g.p_draw, g.p_home FROM oof o JOIN (
  SELECT match_id, sum(CASE WHEN i < j THEN p ELSE 0 END) / sum(p) AS p_away, sum(CASE WHEN i = j THEN p ELSE 0 END) / sum(p) AS p_draw,
         sum(CASE WHEN i > j THEN p ELSE 0 END) / sum(p) AS p_home
  FROM (SELECT match_id, i, j, pow(lh, i) / factorial(i) * pow(la, j) / factorial(j) * TAU AS p
        FROM (SELECT match_id, xG_home AS lh, xG_away AS la FROM oof), (SELECT CAST(range AS INTEGER) AS i FROM range(9)), (SELECT CAST(range AS INTEGER) AS j FROM range(9)))
  GROUP BY match_id) g USING (match_id)""".replace("TAU", tau_sql("i", "j", "lh", "la", "-0.06"))
CTES["dcoof"] = _SCORED + f"({_DC})"
DEPENDS["dcoof"] = ["oof"]


@query("met_recompute", with_ctes(["dcoof"], f"""
SELECT label, count(*) AS n, {r('avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r('avg(ll)')} AS log_loss, {r('avg(br)')} AS brier
FROM (SELECT 'baseline' AS label, pred, y_true, ll, br FROM oof UNION ALL SELECT 'corrected', pred, y_true, ll, br FROM dcoof) GROUP BY label"""))
def met_recompute(spark, sf_dir):
    base, variant = _variant(spark, sf_dir)
    out = M.recompute({"baseline": base, "corrected": variant})
    return rounded(out, "label", "n", accuracy="accuracy", log_loss="log_loss", brier="brier")


@query("met_baselines", with_ctes(["folds", "shin"], f"""
SELECT n.fold, {r('n.l')} AS naive_log_loss, m.k AS market_n, {r('m.l')} AS market_log_loss FROM (
  SELECT f.fold, avg(-ln(greatest(p.share, 1e-15))) AS l FROM folds f JOIN (
    SELECT b.fold, t.res, CAST(count(*) AS DOUBLE) / b.start AS share FROM (SELECT fold, min(pos) AS start FROM folds WHERE fold >= 1 GROUP BY fold) b
    JOIN folds t ON t.pos < b.start GROUP BY b.fold, b.start, t.res) p ON p.fold = f.fold AND p.res = f.res GROUP BY f.fold) n
LEFT JOIN (SELECT f.fold, count(*) AS k, avg(-ln(greatest(CASE f.res WHEN 0 THEN Shin_Prob_A WHEN 1 THEN Shin_Prob_D ELSE Shin_Prob_H END, 1e-15))) AS l
  FROM folds f JOIN shin s USING (match_id) WHERE f.fold >= 1 AND s.ok GROUP BY f.fold) m ON m.fold = n.fold"""))
def met_baselines(spark, sf_dir):
    rows = SP.time_series_folds(batched(spark, sf_dir), ["batch_ts", "match_id"]).withColumn("y_true", F.col("res"))
    return rounded(M.baselines(rows), "fold", "market_n", naive_log_loss="naive_log_loss", market_log_loss="market_log_loss")


@query("agg_class_mix", with_ctes(["matches"], "SELECT res, count(*) AS n FROM matches GROUP BY res"))
def agg_class_mix(spark, sf_dir):
    return M.class_mix(T.matches(spark, sf_dir))


# --- comparison and run outputs -----------------------------------------------------

@query("cmp_paired", with_ctes(["dcoof"], f"""
SELECT b.fold, count(*) AS n, {r('avg(v.ll - b.ll)')} AS ll_delta, {r('avg(v.br - b.br)')} AS brier_delta
FROM oof b JOIN dcoof v ON v.pos = b.pos GROUP BY b.fold"""))
def cmp_paired(spark, sf_dir):
    deltas = C.fold_deltas(C.paired(*_variant(spark, sf_dir)))
    return rounded(deltas, "fold", "n", ll_delta="ll_delta", brier_delta="brier_delta")


def _intervals(spark, sf_dir) -> DataFrame:
    return C.bootstrap_ci(materialize(C.paired(*_variant(spark, sf_dir))))


def _bootstrap_sql() -> str:
    """The weights of the operator, row by row and replicate by replicate, in SQL."""
    P = C.PRIME
    mixed = f"(pos % {P} * 48271 + b * 69621 + {C.SEED * 16807}) % {P}"
    step = "(x * x % {p} * 40692 + x * 30269 + {add}) % {p}"
    weight = " + ".join(f"(x >= {limit})::INT" for limit in C.POISSON_LIMITS)
    return f"""d AS (SELECT b.pos, v.ll - b.ll AS dl, v.br - b.br AS db FROM oof b JOIN dcoof v ON v.pos = b.pos),
x0 AS (SELECT b, dl, db, {mixed} AS x FROM d, (SELECT range AS b FROM range({C.N_BOOTSTRAP}))),
x1 AS (SELECT b, dl, db, {step.format(p=P, add="b + 1")} AS x FROM x0),
x2 AS (SELECT dl, db, b, {step.format(p=P, add=104729)} AS x FROM x1),
rep AS (SELECT b, sum(w * dl) / sum(w) AS ll, sum(w * db) / sum(w) AS br FROM (SELECT b, dl, db, {weight} AS w FROM x2) GROUP BY b HAVING sum(w) > 0),
ci AS (SELECT 'll_delta' AS measure, (SELECT avg(dl) FROM d) AS mean_delta, quantile_cont(ll, 0.025) AS lo, quantile_cont(ll, 0.975) AS hi FROM rep
  UNION ALL SELECT 'brier_delta', (SELECT avg(db) FROM d), quantile_cont(br, 0.025), quantile_cont(br, 0.975) FROM rep)"""


_BOOT = with_ctes(["dcoof", "oof"], "MARK").removesuffix("MARK").rstrip() + ", " + _bootstrap_sql()


@query("cmp_bootstrap", _BOOT + f"""
SELECT (SELECT count(*) FROM d) AS n, measure, {r('mean_delta')} AS mean_delta, {r('lo')} AS ci_low, {r('hi')} AS ci_high FROM ci""")
def cmp_bootstrap(spark, sf_dir):
    return rounded(_intervals(spark, sf_dir), "n", "measure", mean_delta="mean_delta", ci_low="ci_low", ci_high="ci_high")


@query("cmp_verdict", _BOOT + """
SELECT measure, CASE WHEN hi < 0 THEN 'IMPROVEMENT' WHEN lo > 0 THEN 'DEGRADATION' ELSE 'INCONCLUSIVE' END AS verdict FROM ci""")
def cmp_verdict(spark, sf_dir):
    return C.with_verdict(_intervals(spark, sf_dir)).select("measure", "verdict")


@query("snk_oof", with_ctes(["oof"], f"""
SELECT pos, fold, y_true, {r('p_away')} AS p_away, {r('p_draw')} AS p_draw, {r('p_home')} AS p_home FROM oof"""))
def snk_oof(spark, sf_dir):
    """Predictions written as CSV and read back."""
    path = new_path(spark)
    RN.write_oof(goal_oof(spark, sf_dir), path)
    return _oof_rounded(RN.read_oof(spark, path))


@query("snk_runlog", with_ctes(["oof"], f"""
SELECT 'goals' AS name, count(*) AS oof_n, {r('avg(br)')} AS brier_multiclass, 5 AS n_folds FROM oof"""))
def snk_runlog(spark, sf_dir):
    """Run records appended as JSON lines; the latest one of a name read back."""
    path = new_path(spark)
    folds = goal_folds(spark, sf_dir)
    oof = folds.filter("fold >= 1")
    for day in (1, 2):
        RN.append_run(run_record("goals", oof, folds, 2, stamp=STAMP.replace(day=day)), path)
    last = RN.latest_run(RN.read_runs(spark, path), "goals").filter(F.col("experiment_id").contains("20260102"))
    return last.select("name", "aggregate.oof_n", F.round("aggregate.brier_multiclass", 6).alias("brier_multiclass"),
                       F.size("folds").alias("n_folds"))


def _run_log(spark, sf_dir) -> str:
    """A log of two runs and one that fails."""
    log = new_path(spark)
    folds = goal_folds(spark, sf_dir)

    def run(name: str, oof: DataFrame):
        return lambda: (oof, run_record(name, oof, folds, 2, stamp=STAMP))

    def fails():
        raise ValueError("no features")

    base, variant = _variant(spark, sf_dir)
    logged_run(spark, log, "goals", run("goals", base))
    logged_run(spark, log, "corrected", run("corrected", variant))
    logged_run(spark, log, "broken", fails, stamp=STAMP)
    return log


@query("snk_runlog_folds", with_ctes(["folds", "oof", "dcoof"], f"""
SELECT name, f.fold, f.low AS train_n, f.n AS val_n, t.since AS train_since, t.until AS train_until, f.since AS val_since, f.until AS val_until,
  f.low AS first_index, f.high AS last_index, {r('l')} AS log_loss, (SELECT count(*) FROM matches) AS rows_eligible, false AS failed
FROM (SELECT fold, min(pos) AS low, max(pos) AS high, count(*) AS n, min(date)::VARCHAR AS since, max(date)::VARCHAR AS until FROM folds WHERE fold >= 1 GROUP BY fold) f
JOIN (SELECT s.fold, min(x.date)::VARCHAR AS since, max(x.date)::VARCHAR AS until FROM {_STARTS} s JOIN folds x ON x.pos < s.start GROUP BY s.fold) t ON t.fold = f.fold
JOIN (SELECT 'goals' AS name, fold, avg(ll) AS l FROM oof GROUP BY fold UNION ALL SELECT 'corrected', fold, avg(ll) FROM dcoof GROUP BY fold) s ON s.fold = f.fold
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true"""))
def snk_runlog_folds(spark, sf_dir):
    """All records of a log, one row per fold; the failed run has none."""
    runs = RN.read_runs(spark, f"{_run_log(spark, sf_dir)}/runs")
    rows = runs.select("name", "error", "data.rows_eligible", F.explode_outer("folds").alias("f"))
    return rows.select(
        "name", "f.fold", "f.train_n", "f.val_n", F.col("f.train_date_range")[0].alias("train_since"), F.col("f.train_date_range")[1].alias("train_until"),
        F.col("f.val_date_range")[0].alias("val_since"), F.col("f.val_date_range")[1].alias("val_until"), F.col("f.val_index_range")[0].alias("first_index"),
        F.col("f.val_index_range")[1].alias("last_index"), F.round("f.log_loss", 6).alias("log_loss"), "rows_eligible", F.col("error").isNotNull().alias("failed"))


@query("cmp_by_name", with_ctes(["dcoof"], f"""
SELECT 'goals_20260101T000000Z' AS baseline, 'corrected_20260101T000000Z' AS variant, b.fold, count(*) AS n, {r('avg(v.ll - b.ll)')} AS ll_delta,
  {r('avg(v.br - b.br)')} AS brier_delta FROM oof b JOIN dcoof v ON v.pos = b.pos GROUP BY b.fold"""))
def cmp_by_name(spark, sf_dir):
    """Two runs of a log compared by their names."""
    deltas = compare_runs(spark, _run_log(spark, sf_dir), "goals", "corrected")
    out = deltas.groupBy("baseline", "variant", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ll_delta").alias("ll_delta"), F.avg("brier_delta").alias("brier_delta"))
    return rounded(out, "baseline", "variant", "fold", "n", ll_delta="ll_delta", brier_delta="brier_delta")


@query("snk_importance")
def snk_importance(spark, sf_dir):
    path = new_path(spark)
    R.write_importance(mdl_importance(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="feature string, importance double")


@query("snk_input_hash", """
SELECT month, sum(strlen(line) + 1)::BIGINT AS length, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_orderkey || ';' || o_custkey || ';' || o_orderstatus || ';' || o_orderpriority AS line FROM orders)
GROUP BY month""")
def snk_input_hash(spark, sf_dir):
    """Digests of text files, one file per month of orders."""
    path = new_path(spark)
    rows = T.table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("value"))
    rows.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", "value").write.partitionBy("month").text(path)
    found = RN.file_digests(spark, path)
    return found.select(F.regexp_extract("file", "month=([^/]+)/", 1).alias("month"), "length", "sha256")


@query("snk_input_hash_file")
def snk_input_hash_file(spark, sf_dir):
    """Digest of the files of a given table."""
    return RN.input_digests(spark, f"{sf_dir}/orders.parquet")

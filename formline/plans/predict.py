"""Scoring of upcoming fixtures with a fitted outcome model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import scores
from formline.operators import metrics, models

# --- Fixed values: standings of teams missing from the table --------------------
STANDING_DEFAULTS = {"position": ("Position", 30), "points": ("Points", 0),
                     "goals_for": ("GF", 0), "goals_against": ("GA", 0)}


def fixture_features(fixtures: DataFrame, ratings: DataFrame, latest: DataFrame, means: dict[str, float],
                     standings: DataFrame | None = None) -> DataFrame:
    """The model features of fixtures (league, HomeTeam, AwayTeam[, odds]).

    Teams without rating start at the base, without form at the training means.
    The team tables join by (league, team); Spark broadcasts them if small.
    """
    out = fixtures
    for side in ("Home", "Away"):
        key = ["league", f"{side}Team"]
        team = F.col("team").alias(f"{side}Team")
        out = out.join(ratings.select("league", team, F.col("elo").alias(f"{side}_Elo")), key, "left")
        out = out.join(latest.select("league", team, F.col("avg_gf").alias(f"{side}_Avg_GF"),
                                     F.col("avg_ga").alias(f"{side}_Avg_GA"), F.col("form").alias(f"{side}_Form")),
                       key, "left")
        fill = {f"{side}_Elo": K.BASE_ELO}
        fill |= {f"{side}_{c}": means.get(f"{side}_{c}", 1.0) for c in ("Avg_GF", "Avg_GA", "Form")}
        if standings is not None:
            names = {c: f"{side}_Table_{n}" for c, (n, _) in STANDING_DEFAULTS.items()}
            out = out.join(standings.select("league", team, *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
            fill |= {names[c]: d for c, (_, d) in STANDING_DEFAULTS.items()}
        out = out.fillna(fill)
    out = scores.with_balances(scores.with_poisson_features(out))
    if {"odds_h", "odds_d", "odds_a"} <= set(fixtures.columns):
        out = scores.with_shin(out).drop("shin_z")
    else:
        out = out.withColumns({f"Shin_Prob_{x}": F.lit(1.0 / 3.0) for x in "HDA"})
    return with_shrunk_meta(out, means).fillna({c: means.get(c, 0.0) for c in K.FEATURE_COLUMNS})


def with_shrunk_meta(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Expected goals pulled to the league mean as on the first matchday."""
    return df.withColumns({
        f"poisson_xg_{side}_meta": scores.shrunk(
            F.coalesce(F.col(f"xG_{side}"), F.lit(means.get(f"xG_{side}", K.LEAGUE_MEAN_XG))), F.lit(1))
        for side in ("home", "away")})


def predict_fixtures(features: DataFrame, model) -> DataFrame:
    """Probabilities, predicted class, scoreline and label."""
    out = models.with_probabilities(model, features)
    out = out.withColumn("Prediction", metrics.predicted())
    out = scores.with_scoreline(out, "Expected_Home_Goals", "Expected_Away_Goals", "Prediction",
                                "p_home", "p_draw", "p_away")
    out = out.withColumn("Prediction_Label", scores.score_label(F.col("Pred_Home_Goals"), F.col("Pred_Away_Goals")))
    return out.withColumnsRenamed({"p_home": "Pred_Proba_Home", "p_draw": "Pred_Proba_Draw", "p_away": "Pred_Proba_Away"})

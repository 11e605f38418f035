"""The 24-column feature frame of the outcome model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import scores
from formline.operators.batching import assign_batches
from formline.operators.ratings import EloWalk
from formline.operators.windows import (
    STATE_KEY, TRAILING_NAMES, attach_state, both_sides, impute_trailing, team_rows, trailing_state,
)


def team_states(batched: DataFrame, elo: EloWalk, window: int = K.TRAILING_WINDOW, **variants) -> DataFrame:
    """Form and rating of every team before every batch, one row per
    (league, team, batch), so a match joins it once per side."""
    return trailing_state(team_rows(batched), window, **variants).join(elo.before(), STATE_KEY, "left")


def goal_features(matches: DataFrame, elo: EloWalk | None = None) -> DataFrame:
    """Ratings (``elo``, if they have been walked before), form, goal model and balances: all features but the market's."""
    batched = matches if {"batch_ts", "whole_day"} <= set(matches.columns) else assign_batches(matches)
    states = team_states(batched, elo or EloWalk(batched)).fillna({"elo": K.BASE_ELO})
    joined = attach_state(batched, states, *both_sides(TRAILING_NAMES | {"elo": "Elo"}))
    return scores.with_balances(scores.with_poisson_features(impute_trailing(joined)))


def build_features(matches: DataFrame, elo: EloWalk | None = None) -> DataFrame:
    """All 24 features next to the match columns."""
    return scores.with_shin(goal_features(matches, elo)).drop("shin_z")


def eligible(features: DataFrame, base=K.FEATURE_COLUMNS, variant=()) -> DataFrame:
    """Rows with all base features. A variant feature that is null in such a row
    would change the evaluated rows, so it stops the job."""
    rows = features.dropna(subset=list(base))
    for name in variant:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.raise_error(
            f"variant feature {name} is null in an eligible row").cast("double")))
    return rows

"""Tables that several queries build on, stored once per session and input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.catalog import tables as T
from formline.functions import scores as S
from formline.operators.ordering import numbered
from formline.operators.ratings import EloWalk
from formline.operators.splits import equal_blocks, placed_folds
from formline.plans.features import build_features, eligible
from formline.session import stored_once

ORDER = ["batch_ts", "match_id"]


def placed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their batches and their place (``ordinal``) in batch order, the order in which they are stored."""
    return numbered(T.with_batches(spark, sf_dir))


def elo_walk(spark: SparkSession, sf_dir: str) -> EloWalk:
    """The ratings, walked once."""
    return stored_once(spark, lambda: EloWalk(placed_matches(spark, sf_dir)), sf_dir, "elo", inputs=T.match_inputs(sf_dir), write=False)


def placed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model frame, with places."""
    return stored_once(spark, lambda: build_features(placed_matches(spark, sf_dir), elo_walk(spark, sf_dir)), sf_dir, "features",
                       inputs=T.match_inputs(sf_dir))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model frame."""
    return placed_features(spark, sf_dir).drop("ordinal")


def feature_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible model rows with positions and time-series folds."""
    def build() -> DataFrame:
        rows = placed_features(spark, sf_dir)
        return placed_folds(rows, eligible(rows), ORDER)

    return stored_once(spark, build, sf_dir, "folds", inputs=T.match_inputs(sf_dir), write=False)


def goal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches with the form-only goal model's probabilities and folds."""
    from formline.catalog.probability import flat

    def build() -> DataFrame:
        placed = placed_matches(spark, sf_dir)
        rows = S.with_outcome(flat(spark, sf_dir, placed)).withColumnsRenamed(
            {"Poisson_Home_Win": "p_home", "Poisson_Draw": "p_draw", "Poisson_Away_Win": "p_away", "ordinal": "pos"})
        rows = rows.withColumns({"fold": equal_blocks(F.col("pos"), F.lit(placed.count())), "y_true": F.col("res")})
        return rows.select("match_id", "pos", "fold", "date", "y_true", "odds_h", "odds_d", "odds_a", "p_away", "p_draw", "p_home", "xG_home", "xG_away")

    return stored_once(spark, build, sf_dir, "goal folds", inputs=T.match_inputs(sf_dir))


def goal_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold rows of that model."""
    return goal_folds(spark, sf_dir).filter("fold >= 1").select("pos", "fold", "y_true", "p_away", "p_draw", "p_home")

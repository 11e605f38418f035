"""Production training: folds from segments, equal weights, early stopping, and a last fit on all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.operators import metrics, models
from formline.operators.splits import segment_folds
from formline.session import materialize


def train_production(features: DataFrame, order_by: list, names: list[str] = K.FEATURE_COLUMNS,
                     n_splits: int = K.N_SPLITS) -> tuple[models.OutcomeFit, DataFrame, DataFrame]:
    """(final model, out-of-fold predictions, one line per fold).

    Draws are not weighed down. Each fold holds back the last tenth of its training rows to stop early; the final
    model, of all rows, holds nothing back. Lines have ``fold, n_train, n_held, n_tested, accuracy, log_loss``.
    """
    if all(isinstance(c, str) for c in order_by):
        features = features.select(*dict.fromkeys([*order_by, "date", "season", "res", *names]))
    folds = segment_folds(features, order_by, n_splits)
    fits, rows, parts = models.fit_outcome_folds(folds, names, early_stopping=True, final=True)
    oof = materialize(models.score_folds(rows, fits))
    used = [(f, int(p.held), int(p.end - p.held)) for f, p in zip(fits, parts["problems"]) if f is not None]
    lines = features.sparkSession.createDataFrame(used, "fold int, n_train long, n_held long")
    scored = metrics.overall(oof, "fold").select("fold", F.col("n").alias("n_tested"), "accuracy", "log_loss")
    return fits[None], oof, lines.join(scored, "fold")

"""A named experiment: features, folds, out-of-fold scores, run record."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.operators import compare, metrics, models
from formline.operators.batching import assign_batches
from formline.operators.splits import time_series_folds
from formline.operators.windows import with_ewma, with_rolling, with_venue
from formline.plans.features import build_features, eligible
from formline.session import materialize
from formline.sinks import runs

_SIDES = ("Home", "Away")
# Variants: how to add their columns, and which columns those are
VARIANTS = {
    **{f"ewma_hl{h}": (lambda m, h=h: with_ewma(m, (h,)),
                       [f"{s}_EWMA{h}_{k}" for s in _SIDES for k in ("Form", "GF", "GA")])
       for h in K.EWMA_HALFLIVES},
    "venue_split": (with_venue, [f"{s}_Venue_{k}" for s in _SIDES for k in ("Form", "GF", "GA")]),
    "roll_windows": (with_rolling, [f"{s}_Roll{w}_{k}" for w in K.ROLLING_WINDOWS for s in _SIDES for k in ("Form", "GD")]),
}


def experiment_folds(matches: DataFrame, variant: str | None = None,
                     row_id: str = "match_id") -> tuple[DataFrame, list[str]]:
    """Stored feature rows with positions and folds, and the feature names.

    Variant columns are null exactly for teams without history; such cells take
    the same cold-start defaults as the base features.
    """
    features, names = build_features(matches), list(K.FEATURE_COLUMNS)
    extra: list[str] = []
    if variant:
        add, extra = VARIANTS[variant]
        wide = add(assign_batches(matches)).select(row_id, *extra)
        fill = {c: 1.0 if c.endswith("Form") else 0.0 if c.endswith("GD") else K.BASE_GOAL_RATE for c in extra}
        features = features.join(wide.fillna(fill), row_id)
    rows = eligible(features, variant=extra)
    return materialize(time_series_folds(rows, ["batch_ts", row_id])), names + extra


def run_experiment(name: str, matches: DataFrame, variant: str | None = None, draw_weight: float = K.DRAW_WEIGHT,
                   kind: str = "logistic", notes: str = "", log: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(out-of-fold predictions, one-row run record).

    With ``log``, a folder, the run is recorded there. A run that fails is then recorded
    with its error, and has no predictions.
    """
    def build() -> tuple[DataFrame, DataFrame]:
        folds, names = experiment_folds(matches, variant)
        oof = materialize(models.cross_validate(folds, names, draw_weight, kind))
        return oof, run_record(name, oof, folds, len(names), draw_weight, kind, notes, rows_raw=matches.count())

    if log is None:
        return build()
    return logged_run(matches.sparkSession, log, name, build, notes)


def logged_run(spark: SparkSession, log: str, name: str, build: Callable[[], tuple[DataFrame, DataFrame]],
               notes: str = "", stamp: datetime | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Run ``build`` and record its outcome: predictions are written first, the record that names them last.

    So a record never points to predictions that are not there, and a run that broke off in between has no record.
    """
    try:
        oof, record = build()
        run = record.select("experiment_id").first()[0]
        path = f"{log}/oof/{run}"
        runs.write_oof(oof.select(*[f.split()[0] for f in runs.OOF_SCHEMA.split(", ")]), path)
        record = record.withColumn("oof_file", F.lit(path))
    except Exception as error:  # noqa: BLE001  recorded, whatever it is
        oof, record = None, failure_record(spark, name, f"{type(error).__name__}: {error}", notes, stamp)
    record = materialize(record)
    runs.append_run(record, f"{log}/runs")
    return oof, record


def _stamped(name: str, stamp: datetime | None) -> dict[str, str]:
    stamp = stamp or datetime.now(timezone.utc)
    return {"experiment_id": f"{name}_{stamp:%Y%m%dT%H%M%SZ}", "name": name, "timestamp_utc": stamp.isoformat()}


def failure_record(spark: SparkSession, name: str, error: str, notes: str = "", stamp: datetime | None = None) -> DataFrame:
    """The record of a run without result."""
    schema = spark.createDataFrame([], metrics.RECORD).schema
    values = _stamped(name, stamp) | {"notes": notes, "error": error, "folds": []}
    return spark.createDataFrame([tuple(values.get(f) for f in schema.fieldNames())], schema)


def run_record(name: str, oof: DataFrame, folds: DataFrame, n_features: int, draw_weight: float = K.DRAW_WEIGHT,
               kind: str = "logistic", notes: str = "", stamp: datetime | None = None, rows_raw: int | None = None) -> DataFrame:
    """One nested record with configuration, data, folds and aggregate scores.

    Date ranges of training rows come from the ranges of the tested blocks, so rows are aggregated once.
    """
    spans = folds.groupBy("fold").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count(F.lit(1)).alias("rows"),
                                      F.min("date").cast("string").alias("since"), F.max("date").cast("string").alias("until"))
    # One row per fold: bounded by the number of folds.
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "fold", F.col("low").alias("train_n"), F.array(F.min("since").over(before), F.max("until").over(before)).alias("train_date_range"),
        F.array("since", "until").alias("val_date_range"), F.array("low", "high").alias("val_index_range"),
        F.sum("rows").over(Window.partitionBy()).alias("rows_eligible"))
    sizes = metrics.overall(oof, "fold").join(spans.filter(F.col("fold") >= 1), "fold")
    both = sizes.agg(
        F.array_sort(F.collect_list(F.struct(F.col("fold").cast("int").alias("fold"), "train_n", F.col("n").alias("val_n"), "train_date_range",
                                             "val_date_range", "val_index_range", "accuracy", "log_loss"))).alias("folds"),
        F.max("rows_eligible").alias("rows_eligible"), *metrics.spread())
    both = both.withColumn("aggregate", F.struct(
        "oof_n", "mean_accuracy", "std_accuracy", "mean_log_loss", "std_log_loss", "brier_multiclass", "oof_accuracy"))
    return both.select(
        *[F.lit(v).alias(k) for k, v in _stamped(name, stamp).items()], F.lit(notes).alias("notes"),
        F.struct(F.lit(kind).alias("model_type"), F.lit(n_features).alias("n_features"),
                 F.lit(K.N_SPLITS).alias("n_splits"), F.lit(draw_weight).alias("draw_sample_weight")).alias("config"),
        F.struct(F.coalesce(F.lit(rows_raw).cast("long"), F.col("rows_eligible")).alias("rows_raw"), "rows_eligible").alias("data"),
        "folds", "aggregate", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("oof_file"))


def compare_runs(spark: SparkSession, log: str, baseline: str, variant: str) -> DataFrame:
    """Per-match loss differences of the latest runs of two names (variant minus baseline).

    The job fails if a name has no run, or its latest run failed, or the predicted rows differ.
    """
    records = runs.read_runs(spark, f"{log}/runs")
    sides = [runs.latest_run(records, name).first() for name in (baseline, variant)]
    base, other = (runs.read_oof(spark, r["oof_file"]) for r in sides)
    names = {"baseline": sides[0]["experiment_id"], "variant": sides[1]["experiment_id"]}
    return compare.paired(base, other).withColumns({k: F.lit(v) for k, v in names.items()})

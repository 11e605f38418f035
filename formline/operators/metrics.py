"""Scores of out-of-fold predictions: plain aggregates over
(pos, fold, y_true, p_away, p_draw, p_home)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import scores

EPS = 1e-15


def predicted() -> Column:
    """Most likely class; ties go to the lowest class."""
    a, d, h = F.col("p_away"), F.col("p_draw"), F.col("p_home")
    return F.when((a >= d) & (a >= h), 0).when(d >= h, 1).otherwise(2)


def true_probability() -> Column:
    return (F.when(F.col("y_true") == 0, F.col("p_away")).when(F.col("y_true") == 1, F.col("p_draw"))
            .otherwise(F.col("p_home")))


def log_loss() -> Column:
    return -F.log(F.greatest(true_probability(), F.lit(EPS)))


def brier() -> Column:
    def part(p: str, k: int) -> Column:
        return F.pow(F.col(p) - F.when(F.col("y_true") == k, 1.0).otherwise(0.0), F.lit(2.0))
    return part("p_away", 0) + part("p_draw", 1) + part("p_home", 2)


def _standard() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"),
            F.avg((predicted() == F.col("y_true")).cast("double")).alias("accuracy"),
            F.avg(log_loss()).alias("log_loss"), F.avg(brier()).alias("brier")]


def overall(oof: DataFrame, *by: str) -> DataFrame:
    """Row count, accuracy, log loss and Brier score, per group when given."""
    return oof.groupBy(*by).agg(*_standard())


def confusion(oof: DataFrame) -> DataFrame:
    """True class by predicted class, all nine cells present."""
    counts = [F.count_if((F.col("_p") == k)).alias(f"pred_{k}") for k in (0, 1, 2)]
    classes = oof.sparkSession.range(3).select(F.col("id").cast("int").alias("y_true"))
    cells = oof.withColumn("_p", predicted()).groupBy(F.col("y_true").cast("int").alias("y_true")).agg(*counts)
    return classes.join(cells, "y_true", "left").fillna(0)


def draw_report(oof: DataFrame, *by: str) -> DataFrame:
    pred, true = predicted() == 1, F.col("y_true") == 1
    out = oof.groupBy(*by).agg(F.count_if(pred).alias("draw_pred"), F.count_if(true).alias("draw_true"),
                               F.count_if(pred & true).alias("draw_tp"))
    recall = F.when(F.col("draw_true") > 0, F.col("draw_tp") / F.col("draw_true")).otherwise(0.0)
    return out.withColumn("draw_recall", recall)


def per_fold(folds: DataFrame) -> DataFrame:
    """Per fold: sizes, date and position ranges, accuracy and log loss.

    ``folds`` holds all rows (fold 0 too) with ``pos`` and ``date``. Training
    ranges are running values over one row per fold.
    """
    stats = folds.groupBy("fold").agg(
        *_standard(), F.min("date").alias("val_from"), F.max("date").alias("val_to"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    # One row per fold.
    ahead = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    out = stats.withColumns({"train_n": F.sum("n").over(ahead), "train_from": F.min("val_from").over(ahead),
                             "train_to": F.max("val_to").over(ahead)})
    return out.filter(F.col("fold") >= 1).withColumnRenamed("n", "val_n")


def spread() -> list[Column]:
    """Aggregates of ``overall(..., 'fold')`` rows over the folds."""
    def pooled(c: str) -> Column:
        return F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return [F.sum("n").alias("oof_n"),
            F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
            F.avg("log_loss").alias("mean_log_loss"), F.stddev_pop("log_loss").alias("std_log_loss"),
            F.avg("brier").alias("mean_brier"), pooled("brier").alias("brier_multiclass"),
            pooled("accuracy").alias("oof_accuracy"), pooled("log_loss").alias("oof_log_loss")]


def summary(oof: DataFrame) -> DataFrame:
    """Mean and population deviation over folds next to the overall scores."""
    return overall(oof, "fold").agg(*spread())


def recompute(labelled: dict[str, DataFrame]) -> DataFrame:
    """Scores of several prediction sets, one row per label."""
    parts = [df.withColumn("label", F.lit(label)) for label, df in labelled.items()]
    return overall(reduce(DataFrame.unionByName, parts), "label")


def class_mix(df: DataFrame, column: str = "res") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def baselines(folds: DataFrame) -> DataFrame:
    """Log loss per fold of the class shares seen before it (naive) and of the
    market triple, where odds exist.

    ``folds`` holds all rows with fold, y_true and odds. The naive part needs
    only class counts per fold.
    """
    counts = folds.groupBy("fold").agg(*[F.count_if(F.col("y_true") == k).alias(f"n{k}") for k in (0, 1, 2)])
    ahead = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    counts = counts.withColumns({f"t{k}": F.sum(f"n{k}").over(ahead) for k in (0, 1, 2)})
    seen, tested = (scores.total(F.col(f"{x}{k}") for k in (0, 1, 2)) for x in "tn")
    loss = scores.total(
        F.when(F.col(f"n{k}") > 0, -F.col(f"n{k}") * F.log(F.greatest(F.col(f"t{k}") / seen, F.lit(EPS)))).otherwise(0.0)
        for k in (0, 1, 2))
    naive = counts.filter(F.col("fold") >= 1).select("fold", (loss / tested).alias("naive_log_loss"))
    priced = folds.filter((F.col("fold") >= 1) & F.col("odds_h").isNotNull()
                          & F.col("odds_d").isNotNull() & F.col("odds_a").isNotNull())
    market = scores.with_shin(priced, names=("p_home", "p_draw", "p_away")).groupBy("fold").agg(
        F.count(F.lit(1)).alias("market_n"), F.avg(log_loss()).alias("market_log_loss"))
    return naive.join(market, "fold", "left")


FOLD = ("struct<fold:int,train_n:long,val_n:long,train_date_range:array<string>,val_date_range:array<string>,"
        "val_index_range:array<long>,accuracy:double,log_loss:double>")
RECORD = (
    "experiment_id string, name string, timestamp_utc string, notes string, "
    "config struct<model_type:string,n_features:int,n_splits:int,draw_sample_weight:double>, "
    "data struct<rows_raw:long,rows_eligible:long>, "
    f"folds array<{FOLD}>, "
    "aggregate struct<oof_n:long,mean_accuracy:double,std_accuracy:double,mean_log_loss:double,"
    "std_log_loss:double,brier_multiclass:double,oof_accuracy:double>, error string, oof_file string"
)


def leaderboard(records: DataFrame) -> DataFrame:
    """One line per run record; failed runs show their error only."""
    ordered = F.array_sort("folds", lambda a, b: a["fold"] - b["fold"])

    def text(field: str) -> Column:
        return F.array_join(F.transform(ordered, lambda f: F.format_string("%.4f", f[field])), " ")

    ok = F.col("error").isNull()
    a = F.col("aggregate")
    return records.select(
        "name", F.col("config.n_features").alias("n_features"),
        *[F.when(ok, F.round(a[c], 4)).alias(c) for c in (
            "mean_accuracy", "std_accuracy", "mean_log_loss", "std_log_loss", "brier_multiclass")],
        F.when(ok, a["oof_n"]).alias("oof_n"),
        F.when(ok, text("log_loss")).alias("fold_log_loss"), F.when(ok, text("accuracy")).alias("fold_accuracy"),
        F.when(~ok, F.concat("name", F.lit(": ERROR"))).alias("failure"))

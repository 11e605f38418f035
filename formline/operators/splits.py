"""Time-ordered folds. A fold number says where a row is tested; its training
rows are those placed before the fold's first tested row."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline import constants as K
from formline.operators.ordering import with_ordinal
from formline.operators.windows import season_segments

BLOCK = 1 << 20


def time_series_folds(df: DataFrame, order_by: list[str | Column], n_splits: int = K.N_SPLITS) -> DataFrame:
    """Add ``pos`` and ``fold``: fold ``f`` tests the f-th of the last
    ``n_splits`` equal blocks; rows before them have fold 0."""
    rows = with_ordinal(df, order_by, "pos", total="_n")
    return rows.withColumn("fold", equal_blocks(F.col("pos"), F.col("_n"), n_splits)).drop("_n")


def equal_blocks(pos: Column, n: Column, n_splits: int = K.N_SPLITS) -> Column:
    """The fold of a row at position ``pos`` of ``n``: see ``time_series_folds``."""
    size = F.floor(n / (n_splits + 1))
    start = n - size * n_splits
    return F.when(pos >= start, F.floor((pos - start) / size) + 1).otherwise(0).cast("int")


def placed_folds(placed: DataFrame, kept: DataFrame, order_by: list[str | Column], ordinal: str = "ordinal",
                 n_splits: int = K.N_SPLITS) -> DataFrame:
    """``time_series_folds`` of rows that carry their dense place among all rows of ``placed``.

    If ``kept`` has all of them, places are positions, and the wide rows are not sorted; otherwise they are numbered anew.
    """
    n = placed.count()
    if kept.count() < n:
        return time_series_folds(kept.drop(ordinal), order_by, n_splits)
    rows = kept.withColumnRenamed(ordinal, "pos")
    return rows.withColumn("fold", equal_blocks(F.col("pos"), F.lit(n), n_splits))


def _segment_fold(segment: Column, n_segments: int, n_splits: int) -> Column | None:
    """Fold of a segment, null where it is never tested; None if fewer than two
    folds have training rows. The first fold has none and is left out."""
    splits = min(n_splits, max(2, n_segments))
    per_fold = max(1, n_segments // splits)
    usable = min(splits, -(-n_segments // per_fold)) - 1
    if n_segments < 2 or usable < 2:
        return None
    number = F.floor(segment / per_fold).cast("int")
    return F.when((number >= 1) & (number < splits), number)


def _fall_back(df: DataFrame, order_by, n_splits: int, found: int) -> DataFrame:
    warnings.warn(f"{found} segment(s) give fewer than two folds; using equal blocks", stacklevel=3)
    rows = time_series_folds(df, order_by, n_splits)
    return rows.withColumns({"segment": F.lit(None).cast("int"), "fold": F.nullif("fold", F.lit(0))})


def segment_folds(matches: DataFrame, order_by: list[str | Column], n_splits: int = K.N_SPLITS,
                  gap_days: int = K.SEGMENT_GAP_DAYS) -> DataFrame:
    """Add ``pos``, ``segment`` and ``fold`` from season changes and date gaps."""
    segments = season_segments(matches, gap_days)
    found = (segments.agg(F.max("segment")).first()[0] or 0) + 1
    fold = _segment_fold(F.col("segment"), found, n_splits)
    if fold is None:
        return _fall_back(matches, order_by, n_splits, found)
    # Bounded by the calendar: one row per date and season.
    days = F.broadcast(segments.select("date", "season", "segment"))
    return with_ordinal(matches, order_by, "pos").join(days, ["date", "season"]).withColumn("fold", fold)


def with_group_segments(df: DataFrame, order_by: list[str | Column], group: str) -> DataFrame:
    """Add ``pos`` and ``segment``, which grows by one wherever ``group`` changes.

    Rows are numbered in blocks of at most ``BLOCK``; only block totals and the
    last group of each block are carried over, so no task sees all rows.
    """
    rows = with_ordinal(df, order_by, "pos").withColumn("_block", F.floor(F.col("pos") / BLOCK))
    lasts = rows.groupBy("_block").agg(F.max_by(F.struct(group), "pos").alias("_last"))
    rows = rows.join(lasts.select((F.col("_block") + 1).alias("_block"), "_last"), "_block", "left")
    inside = Window.partitionBy("_block").orderBy("pos")
    before = F.coalesce(F.lag(F.struct(group)).over(inside), F.col("_last"))
    rows = rows.withColumn("_new", (~F.struct(group).eqNullSafe(before)).cast("long"))
    rows = rows.withColumn("_in", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("_block").agg(F.sum("_new").alias("_n"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return (rows.join(carried, "_block").withColumn("segment", (F.col("_before") + F.col("_in") - 1).cast("int"))
            .drop("_block", "_last", "_new", "_in", "_before"))


def group_folds(df: DataFrame, order_by: list[str | Column], group: str, n_splits: int = K.N_SPLITS) -> DataFrame:
    """Add ``pos``, ``segment`` and ``fold`` from changes of an explicit group column."""
    rows = with_group_segments(df, order_by, group)
    found = (rows.agg(F.max("segment")).first()[0] or 0) + 1
    fold = _segment_fold(F.col("segment"), found, n_splits)
    if fold is None:
        return _fall_back(df, order_by, n_splits, found)
    return rows.withColumn("fold", fold)


def early_stop_flag(train: DataFrame, n_train: Column, pos: str = "pos") -> DataFrame:
    """Mark the last tenth (at least one row) of a training fold, whose rows are
    at positions 0..n-1."""
    size = F.greatest(F.floor(n_train / 10), F.lit(1))
    return train.withColumn("is_validation", F.col(pos) >= n_train - size)


def fold_borders(folds: DataFrame) -> DataFrame:
    """(fold, start, n_train, n_val) of contiguous folds with positions."""
    return folds.filter(F.col("fold") >= 1).groupBy("fold").agg(
        F.min("pos").alias("start"), F.min("pos").alias("n_train"), F.count(F.lit(1)).alias("n_val"))

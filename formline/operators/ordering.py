"""Global positions and split points over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import materialize

_LOW_BITS = 33


def with_ordinal(df: DataFrame, order_by: list[str | Column], name: str = "ordinal",
                 total: str | None = None) -> DataFrame:
    """Dense 0-based position of every row in a total order.

    A range-partitioned sort spreads even one hot key over many tasks (make the
    order unique by ending it with a row id). The sorted rows are written once,
    so the per-task row numbers are frozen; only one count per task is then
    accumulated, and that table is as small as the number of tasks.
    """
    return numbered(sorted_rows(df, order_by), name, total)


def sorted_rows(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """The rows stored in order, with ``_mid``: the task that sorted a row, and its number there."""
    return materialize(df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, name: str = "ordinal", total: str | None = None) -> DataFrame:
    """Positions of ``sorted_rows``."""
    rows = rows.withColumn("_task", F.shiftright("_mid", _LOW_BITS))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_task",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    in_task = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    # One row per sort task: bounded by the number of tasks, not by the data.
    out = rows.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_before") + in_task)
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_mid", "_task", "_before", "_total")

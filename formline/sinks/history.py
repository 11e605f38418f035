"""Incremental load of new results into the match history.

The history is a folder of batches, each partitioned by month. A load compares its keys with the
months it brings only, writes only the rows that are new, and is visible once its commit record
is written: a load that broke off leaves nothing to be seen, one that is repeated adds nothing.
One load runs at a time; what is committed is never rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.session import materialize

KEYS = ["Date", "Home", "Away"]
COMMIT = "seq long, batch string, folder string, n_new long, columns array<string>, files array<string>"
#: The month of dates that cannot be read.
NO_MONTH = "none"


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Dated incoming rows whose (Date, Home, Away) is not in the history yet;
    repeats inside the incoming rows stay."""
    return incoming.filter(F.col("Date").isNotNull() & (F.col("Date") != "")).join(
        existing.select(*KEYS).distinct(), KEYS, "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, source: str = "source_file") -> DataFrame:
    """History with the new rows: existing column order first, new columns after,
    nulls where a side lacks a column, sorted by date."""
    fresh = new_rows(existing, incoming).drop(source)
    order = existing.columns + [c for c in fresh.columns if c not in existing.columns]
    both = existing.unionByName(fresh, allowMissingColumns=True).select(*order)
    return both.orderBy(F.try_to_date("Date", "d/M/yyyy").asc_nulls_last(), "Home", "Away")


def contributing_files(existing: DataFrame, incoming: DataFrame, source: str = "source_file") -> DataFrame:
    """Source files that brought at least one new row."""
    return new_rows(existing, incoming).select(source).filter(F.col(source).isNotNull()).distinct()


def write_history(history: DataFrame, path: str) -> None:
    """Write to a new path; existing data is never rewritten in place."""
    history.write.mode("error").option("header", True).csv(path)


def commits(spark: SparkSession, path: str) -> list:
    """The commit records of a history, first to last: one per load."""
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits").orderBy("seq").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _with_month(rows: DataFrame) -> DataFrame:
    day = F.coalesce(F.try_to_date("Date", "d/M/yyyy"), F.try_to_date("Date", "yyyy-MM-dd"))
    return rows.withColumn("month", F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_MONTH)))


def read_history(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """All committed rows, older columns first; with ``months`` only those partitions are read.

    Loads that brought no column before are null there.
    """
    done = commits(spark, path)
    if not done:
        raise ValueError(f"no history at {path}")
    columns = list(dict.fromkeys(c for d in done for c in d["columns"]))
    folders = [f"{path}/rows/{d['folder']}" for d in done if d["n_new"]]
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{path}/rows").parquet(*folders)
    if months is not None:
        rows = rows.where(F.col("month").isin(months))
    return rows.select(columns)


def append_batch(spark: SparkSession, path: str, incoming: DataFrame, batch: str, source: str = "source_file") -> int:
    """Add the rows of ``incoming`` that are not in the history yet; the number of rows added.

    A batch that is committed is not looked at again. The first load makes the history. The commit record names
    the source files that brought new rows.
    """
    done = commits(spark, path)
    if any(d["batch"] == batch for d in done):
        return 0
    rows = _with_month(incoming)
    if any(d["n_new"] for d in done):
        # Months are bounded by the calendar; the filter prunes the partitions of all earlier loads.
        months = [r["month"] for r in rows.select("month").distinct().collect()]
        rows = new_rows(read_history(spark, path, months), rows)
    else:
        rows = rows.filter(F.col("Date").isNotNull() & (F.col("Date") != ""))
    fresh = materialize(rows)
    n = fresh.count()
    files = sorted(r[source] for r in fresh.select(source).distinct().collect() if r[source]) if source in fresh.columns else []
    kept = fresh.drop(source)
    folder = f"load={uuid.uuid4().hex}"
    if n:
        kept.write.mode("error").partitionBy("month").parquet(f"{path}/rows/{folder}")
    record = (len(done), batch, folder, n, [c for c in kept.columns if c != "month"], files)
    spark.createDataFrame([record], COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")
    return n

"""Tables derived from the given ones: matches and the text feeds about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators.batching import UNDATED, assign_batches
from formline.operators.ordering import sorted_rows
from formline.session import materialize, stored_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the name of their nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (table(spark, sf_dir, "customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .drop("n_nationkey"))


def match_inputs(sf_dir: str) -> list[str]:
    """The files the match table comes from."""
    return [f"{sf_dir}/{name}.parquet" for name in ("orders", "customer", "nation")]


def sorted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match table with its batches, derived once and stored in batch order: most jobs scan it several times
    (days, states, matches) and each scan then reads only its own columns. Files are even, whatever the skew of the
    joins it comes from, and follow the calendar: a task sees few batches, and the cuts and counts by batch shrink its
    rows before they are moved. The joined rows are stored before the sort, which reads them twice."""
    def build() -> DataFrame:
        return sorted_rows(assign_batches(materialize(derive_matches(spark, sf_dir)), undated=True), ["batch_ts", "match_id"])

    return stored_once(spark, build, sf_dir, "matches", inputs=match_inputs(sf_dir), write=False)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match table."""
    return sorted_matches(spark, sf_dir).drop("batch_ts", "whole_day", "_mid")


def with_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match table with ``batch_ts``, ``whole_day`` and ``_mid``; a match without a date stops the job."""
    dated = F.when(F.col("batch_ts").isNull(), F.raise_error(UNDATED).cast("boolean")).otherwise(True)
    return sorted_matches(spark, sf_dir).filter(dated)


def derive_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match per order, between nations, by priority class."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    hour = F.lpad((key % 10 + 12).cast("string"), 2, "0")
    minute = F.lpad((key % 4 * 15).cast("string"), 2, "0")
    priced = key % 3 != 0
    guest = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_away"), F.col("n_name").alias("away"))
    rows = (
        table(spark, sf_dir, "orders")
        .join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("_away", ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int"))
        .join(guest, "_away")
        .select(
            key.alias("match_id"),
            F.col("o_orderpriority").alias("league"),
            F.year("o_orderdate").cast("string").alias("season"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.when(key % 11 == 0, None).when(key % 13 == 0, "00:30")
            .otherwise(F.concat_ws(":", hour, minute)).alias("kickoff"),
            F.col("n_name").alias("home"),
            "away",
            (cents % 5).cast("int").alias("hg"),
            (F.floor(cents / 7) % 4).cast("int").alias("ag"),
            F.when(priced, 1.5 + (key % 17) / 10).alias("odds_h"),
            F.when(priced, 3.0 + (key % 7) / 10).alias("odds_d"),
            F.when(priced, 2.0 + (key % 23) / 10).alias("odds_a"),
        )
    )
    res = F.when(F.col("hg") > F.col("ag"), 2).when(F.col("hg") == F.col("ag"), 1).otherwise(0)
    return rows.withColumn("res", res)

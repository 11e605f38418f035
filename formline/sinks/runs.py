"""Run records, out-of-fold predictions and input digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators.metrics import RECORD
from formline.sources.files import file_digests

OOF_SCHEMA = "pos long, fold int, y_true int, p_away double, p_draw double, p_home double"


def write_oof(oof: DataFrame, path: str) -> None:
    oof.write.mode("error").option("header", True).csv(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=OOF_SCHEMA)


def append_run(record: DataFrame, path: str) -> None:
    """Append run records as JSON lines."""
    record.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def latest_run(runs: DataFrame, name: str) -> DataFrame:
    """The last record of an experiment; the job fails if that record failed or
    there is none."""
    last = runs.filter(F.col("name") == name).agg(F.max_by(F.struct(*runs.columns), "timestamp_utc").alias("r"))
    state = (F.when(F.col("r").isNull(), F.raise_error(f"no run named {name}"))
             .when(F.col("r.error").isNotNull(), F.raise_error(F.concat(F.lit(f"latest run {name} failed: "), "r.error")))
             .otherwise(F.col("r.name")))
    return last.withColumn("_name", state.cast("string")).filter(F.col("_name").isNotNull()).select("r.*")


def input_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of every input file, of any size."""
    found = file_digests(spark, path)
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "length", "sha256")

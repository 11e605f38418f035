"""Match history: explicit schema, cleaning, entity normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import scores
from formline.operators.entities import normalize_names

RAW_SCHEMA = (
    "Date string, Time string, Home string, Away string, HG int, AG int, Res string, "
    "Season string, League string, B365CH double, B365CD double, B365CA double"
)
REQUIRED = ("Home", "Away", "Res", "Date")


def read_matches(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """Raw match rows of a CSV with a header line."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def clean_matches(raw: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Typed match rows: incomplete rows and unparseable dates are dropped, dates
    are read day first, names normalised and results encoded as 2/1/0."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"match history lacks columns: {missing}")
    rows = raw.dropna(subset=["Home", "Away", "Res"])
    day = F.coalesce(F.try_to_date("Date", "d/M/yyyy"), F.try_to_date("Date", "yyyy-MM-dd"),
                     F.try_to_date("Date", "d-M-yyyy"), F.try_to_date("Date", "d/M/yy"))
    rows = rows.withColumn("Date", day).filter(F.col("Date").isNotNull())
    clock = F.trim(F.coalesce(F.col("Time"), F.lit(""))) if "Time" in raw.columns else F.lit("")
    number = F.col("Res").try_cast("int")
    rows = rows.withColumns({"Time": clock, "Res": F.coalesce(scores.encode_result(F.col("Res")), number)})
    return normalize_names(normalize_names(rows, "Home", "Home", glossary), "Away", "Away", glossary)

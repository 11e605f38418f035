"""What the corpus operators share: reading tables and carrying columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null document id wherever ids are compared; it sorts first.
NULL_ID = -(2 ** 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: Iterable[str] = ()) -> DataFrame:
    """``doc_id`` long, ``text`` string (null: empty) and the struct ``carried``.

    Only the named columns are read, so other columns may have any name or type.
    ``carried`` is present if ``carry`` names columns.
    """
    out: list[Column] = [
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ]
    if carry := list(carry):
        out.append(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"))
    return docs.select(*out)


def carried(df: DataFrame) -> list[str]:
    return ["carried"] if "carried" in df.columns else []


def schema_of(ddl: str, df: DataFrame) -> T.StructType:
    """The named columns and, if ``df`` has it, its ``carried``."""
    return T.StructType(T._parse_datatype_string(ddl).fields + [df.schema[c] for c in carried(df)])

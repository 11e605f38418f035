"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, documents, folder of the tables), works on every document it is
given, and returns documents with the same columns; the last returns packed pieces.
``n_chars`` always counts the code points of the text as it is then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import line_dedup, minhash, packing, secrets, toxicity

KEPT = ["text", "lang", "source"]


def _documents(rows: DataFrame, text) -> DataFrame:
    """The columns of ``documents``, with ``text`` and what was carried."""
    return rows.select("doc_id", text.alias("text"), "carried.lang", "carried.source",
                       F.length(text).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labels of the documents given."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, carry=["lang", "source"], keep_text=True)
    return _documents(scored.where(F.col("predicted") == 0), F.col("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document keeps."""
    return _documents(line_dedup.dedup_lines(docs, carry=["lang", "source"]), F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of every class of near duplicates."""
    return _documents(minhash.one_per_class(docs, carry=KEPT), F.col("carried.text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of a secret replaced."""
    return _documents(secrets.find_secrets(docs, carry=["lang", "source"]), secrets.redacted())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier, the signatures and the tokenizer have no SQL form; tests hold the stages against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

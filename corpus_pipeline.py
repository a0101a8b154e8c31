"""A corpus pipeline: quality rules, near copies, secrets, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as parquet into the shared
folder and reads it again for the next.  All stages but the last return the columns of ``docs``.  No SQL is given:
the first stages' verdicts are not SQL; each stage's operator is held to brute force in its own tests, and the stages are
tested for rows, columns and odd rows.

Null and empty texts are documents without words: the quality rules drop them.  Rows with equal or null ids are rows of
their own; texts are taken whole; an empty table goes through all stages; further columns, of any name, are kept by
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import catalog, lines, mix, secret_scan, simhash
from kiln.llm.scratch import prepare, table
from kiln.session import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (operator 9)."""
    prepare(spark)
    return lines.keep(docs, lines.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 5)."""
    prepare(spark)
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts (operator 10); ``n_chars`` follows."""
    prepare(spark)
    ledger = fresh_path(spark, "llm-ledger")
    secret_scan.scan(docs, ledger)
    out = secret_scan.redacted(docs, ledger)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (operator 3)."""
    prepare(spark)
    return mix.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens (operator 1)."""
    prepare(spark)
    return catalog.pieces(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", secrets), ("mix", mixed), ("pack", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"llm-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

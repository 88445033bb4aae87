"""From raw documents to packed sequences: quality, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``, extra ones included, whatever their names.
Null and empty texts go in the first stage (a later stage that meets one keeps it, but the mix, which counts words).
Ties go by hashes of id and text. Rows without an id are documents like others, rows that repeat id and text are one
from the second stage on. Empty tables stay empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselwork.llm import pii, quality_model
from tesselwork.llm.catalog import vocabulary
from tesselwork.llm.mixing import repeated_rows
from tesselwork.llm.near_dup import one_of_each
from tesselwork.llm.packing import pack
from tesselwork.sources.scratch import written
from tesselwork.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; so do null and empty texts."""
    return quality_model.good_rows(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more.

    Of rows that repeat id and text one stays; rows that share an id but not their text are different documents.
    """
    return one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked by their kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: words taken over its size, rounded. Texts without words go."""
    return repeated_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, vocabulary(), length=1024)


STAGES = [("quality classifier", quality), ("near-duplicates", near_dup), ("personal data", personal_data), ("source mix", source_mix), ("packing", packing)]

#: The classifier, the tokenizer and the packing cannot be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

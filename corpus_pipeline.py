"""A training corpus from raw documents: filter, dedup, decontaminate, redact, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  Between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewright.llm.common import staged
from lanewright.llm.decontaminate import decontaminate
from lanewright.llm.neardup import keep_one
from lanewright.llm.packing import pack_documents
from lanewright.llm.quality import keep_good
from lanewright.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from those labels whose documents are still there."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item, verbatim or re-parameterised, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a marker."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier's training and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the packing of what the stages leave of ``documents``.

    Null and empty texts go in the first stage.  Repeated rows of an id stay or
    go together; a null id is kept unless its text is rejected or a copy of
    another's, and can't be reported as contaminated.  Very long texts are read
    whole by every stage.  Further columns are kept up to the packing, whatever
    their names.  Empty tables give no rows; without labels the classifier's
    fixed scorer stands in.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs

"""The corpus pipeline: quality, toxicity, near-duplicates, personal data, packing.

Each stage's rows are written as Parquet and reread as the next one's documents, so a stage never repeats the
work before it and an executor's loss costs no more than its own tasks. Every stage takes empty tables, and
columns beyond those of documents go through to the last stage. Labels come from the same folder as
the documents; where it has none of use, the classifiers reject nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewise.llm import crf_quality, dart_minhash, harmonic, ordinal_toxicity, pii
from tapewise.llm.common import table
from tapewise.sources import staging


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good; all, if the labels cannot teach it. Null texts are scored as empty ones, rows of null or repeated ids one by one."""
    return crf_quality.keep_good(docs, crf_quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not grade as toxic; all, if the labels cannot teach it. Null and empty texts stay."""
    return ordinal_toxicity.keep_clean(docs, ordinal_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id (null last). Texts without words are no one's duplicates."""
    return dart_minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the personal data in their texts replaced by its kind. Every row stays; null texts stay null."""
    return pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens. Null and empty texts have their end token; rows of null or repeated ids are packed each."""
    return harmonic.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: The stages learn models and hash texts, which SQL cannot say; tests hold them against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

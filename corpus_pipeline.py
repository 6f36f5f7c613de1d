"""The corpus pipeline over ``documents``: each stage is written and read again.

1. language: documents whose language can't be told (no letter, or a score below 0.3) go.
2. near_duplicates: of each group of linked documents the one with the least doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets in the texts are replaced; every document stays.
5. tokens: BPE ids of each text, as digests.

Stages 1 to 4 return the columns they were given.  Each works on all rows that its
predecessor kept, and on whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dupescope.llm import bpe, common, decontaminate, jaccard, language, secrets


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_texts(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: A network, link components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes when the next one stands."""
    tables = common.Workspace(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, tables.write(stage(spark, docs, sf_dir), name)
        if k:
            tables.drop(before)
    return docs

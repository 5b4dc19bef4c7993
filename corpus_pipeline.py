"""Corpus pipeline: raw documents to a mixed training schedule, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's
``docs``. All but the last return the columns of ``documents``.

1. quality: documents that the byte-level network scores under 0.3 go.
2. near_duplicates: of each class of linked rows the one with the smallest id
   stays (null ids last; of equal ids the first one read). Rows are told apart
   by their places, so ids may be null or repeated. Rows without words stay.
3. decontamination: rows that hold a benchmark item go, whatever their ids.
4. secrets: secrets are replaced in the texts; every document stays.
5. mix: how many words of each document the mix takes.

Empty tables give empty results. Extra columns of ``documents`` are carried
along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bytecnn, decontam, jaccard, mix, secret_scan
from tidemark.llm.common import Scratch, held_out, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = bytecnn.train(docs, table(spark, sf_dir, "labels"), keep=~held_out("doc_id", 5, 0))
    kept = bytecnn.score(docs, model, out="_score")
    return kept.where("_score >= 0.3").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.train())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.taken(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mix", mixing)]

#: A trained network and hashes of shingles can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), []
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)   # nothing reads it any more
        before = [name]
    return docs

"""A corpus pipeline of five stages over ``documents``: toxic documents go, one of
each group of near-duplicates stays, contaminated documents go, secrets are masked,
and what is left is packed. Each stage's result is written and read again.

Defined results: null and empty texts are copies of one another, so one row of them stays, the one
with the smallest doc_id; null doc_ids have no labels and come after all others. Of rows alike in
all columns one stays. Stages but the last keep all columns, whatever their names. Empty documents
give no rows; without labels nothing is toxic, and an empty benchmark contaminates nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontaminate, pack, secrets, simhash, toxicity
from quarryline.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.remove(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Learned scores and best fit aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None

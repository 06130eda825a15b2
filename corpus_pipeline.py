"""The pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm import decontaminate, language, packing, simhash_dedup, toxicity
from tablewake.llm.queries import byte_bpe, byte_bpe_added, language_may_learn, toxicity_may_learn
from tablewake.session import counted_save_point, save_folder


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids in ``gone``. Ids are sent to all tasks only if they were counted and are few."""
    ids, counts = counted_save_point(gone.select("doc_id").distinct())
    few = counts["rows"] <= decontaminate.BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(toxicity_may_learn()), labels)
    return toxicity.add_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: those without a letter, and those that share no n-gram with any
    language's profile, whose score is 0."""
    profiles = language.learn(docs, language_may_learn())
    found = language.add_language(docs, profiles)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Documents without an id cannot be told apart and stay; rows that repeat an id are one document.
    """
    return without(docs, simhash_dedup.simhash_groups(docs).where("doc_id <> component_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.contamination(docs, benchmark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into windows."""
    return packing.pack(docs, *byte_bpe(), added=byte_bpe_added())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The classifiers, fingerprints and token ids cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Below the save points, so that `clear_save_points` removes the stages' tables, too, once the result is written.
    folder = f"{save_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

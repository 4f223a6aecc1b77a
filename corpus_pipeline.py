"""From raw documents to shards: the corpus pipeline, each stage one operator of tapeworks.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tapeworks.functions.state import shared_folder
from tapeworks.llm.decontaminate import drop_contaminated
from tapeworks.llm.jaccard_join import keep_one_of_each
from tapeworks.llm.line_crf import score_documents, train
from tapeworks.llm.mixing import mix_sources
from tapeworks.llm.sharding import assign_shards


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject (score 0.3 or more)."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, name="__score").where("__score >= 0.3").drop("__score")


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest number."""
    return keep_one_of_each(docs).select(*docs.columns)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources; each at least once."""
    return mix_sources(docs).select(*docs.columns)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows with their shard and place in it."""
    return assign_shards(docs, 24)


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("mix", _mix),
    ("shard", _shard),
]
#: No SQL: the classifier is trained. tests/llm compares each stage on a small table with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

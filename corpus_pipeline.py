"""A training corpus from ``documents``: reject, dedup, join near copies, mix to targets, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisflow.llm import bpe, line_dedup, mixing, ngram_join, quality
from basisflow.llm.common import table
from basisflow.llm.queries import RANKS, TARGETS
from basisflow.plans.lineage import checkpoint_folder

#: a document scores below it if it is more likely than not to be rejected, given how rare rejects are
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labels' own documents."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accept(docs, model, LEAST_QUALITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line chunks seen before go; a document that has none left goes with them."""
    lean = line_dedup.dedup(docs).where("text <> '' or n_removed_lines = 0").withColumn("n_chars", F.length("text").cast("long"))
    return lean.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    first = ngram_join.join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, F.col("doc_id") == F.col("_first"), "left_semi").unionByName(docs.where("doc_id is null"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares meet the targets."""
    return mixing.sample(docs, TARGETS, derived={"topic": mixing.topic()})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of what they decode to."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", one_of_each_group),
          ("mixing sources to target weights", mix_to_targets), ("byte-level BPE encoding and decoding", encode)]
#: a trained classifier and raking are no SQL: tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

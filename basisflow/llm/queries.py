"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basisflow.llm import ann, bpe, embed_dedup, licenses, line_dedup, lm_score, mixing, ngram_join, prefix_trie, quality, secrets, spelling, suffix_dedup
from basisflow.llm.common import table
from basisflow.plans.lineage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: token shares to which the corpus is mixed
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14},
    "topic": {"long": 0.62, "short": 0.33, "table": 0.02, "markup": 0.02, "capitals": 0.01},
}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


@query("op1_line_dedup", line_dedup.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard_join", ngram_join.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op3_lm_score")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score(docs, lm_score.train(docs)).drop("text")


@query("op4_secret_scan", secrets.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(table(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = mixing.measure(table(spark, sf_dir, "documents").withColumn("topic", mixing.topic()))
    narrow = written(measured.select("doc_id", "source", "lang", "topic", "tokens", "draw"), "measured")
    return mixing.mix(narrow, TARGETS).drop("draw")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), digests=True)


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), F.col("score_passages").alias("n_passages"))


@query("op9_embedding_near_dedup", embed_dedup.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search_all(ann.build_all(vectors), vectors.where("vec_id % 20 = 0"))


@query("op11_conversation_trie", prefix_trie.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_spelling_variants", spelling.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op13_license_scan", licenses.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))

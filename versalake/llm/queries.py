"""The queries of the training-data operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.llm import ann, bpe_codec, language, line_dedup, mixing, near_dedup, quality, sharding, token_files, token_trees
from versalake.llm.common import documents, tokenizer_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer_path(), end=2)


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_source_mix"] = mixing.SQL


@query
def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 16)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


ORACLES["op8_line_dedup"] = line_dedup.SQL


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, quality.model(docs, labels))


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.neighbours(vectors, F.col("id") % 20 == 0, k=20)


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trees.recount(documents(spark, sf_dir), tokenizer_path())


@query
def op1_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trees.recount(documents(spark, sf_dir), tokenizer_path(), token_trees.workload())

"""From raw documents to token ids, in stages: language ID, line dedup, near dedup, source mix, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that it gets and returns the columns of `docs`; the last one
returns the tokens. `run` writes every stage's result to the shared folder and reads it again, so a lost executor
costs no more than the tasks of the stage that it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versalake.llm import bpe_codec, language, line_dedup, mixing, near_dedup
from versalake.llm.common import discard, documents, tokenizer_path, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or no language that is likely enough."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return language.predict(docs, model).where(~F.col("rejected")).select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops long lines that many documents hold from all of them but the last; n_chars follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every class of near duplicates."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents until the sources stand at their target weights; a document taken twice is there twice."""
    return mixing.apply(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text decoded from them."""
    return bpe_codec.digests(docs.select("doc_id", "source", "lang", "text"), tokenizer_path(), ids=True)


STAGES = [("language", known_language), ("line_dedup", lines_once), ("near_dedup", one_of_each), ("mix", mixed), ("bpe", tokens)]

#: Language ID and near dedup are no SQL; tests/llm/test_pipeline.py holds a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # a stage's result is used up once the next one's is written
    return STAGES[-1][1](spark, docs, sf_dir)

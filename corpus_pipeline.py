"""The corpus pipeline: five stages, each by an operator of vintage.llm.

A stage takes the documents its predecessor kept and returns those it keeps
(the last returns the index of the token files). `run` writes every stage as
Parquet to the session's shared folder and reads it back for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vintage.llm import decontaminate, langid, mixing, ngram_join, token_output
from vintage.llm.common import scratch, ship, table
from vintage.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    ship(spark)
    return langid.in_known_languages(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the words of each document in the drawn blocks, as often as
    they are drawn; blocks of one round that adjoin stay one text."""
    return mixing.joined_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix: a row for each stored text."""
    ship(spark)
    path, out = tokenizer_file("byte_bpe_50k.json"), scratch(spark, "ids")
    token_output.write_token_files(docs, out, path, end_id=2)
    return token_output.read_token_files(spark, out, token_output.id_width(path)).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("mixing sources to target weights", mix), ("token-ID / binary output", tokens)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against
#: plain Python on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs

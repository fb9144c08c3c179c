"""From raw documents to training tokens: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm._common import stage as staged
from verdigris.llm.bpe import bpe_tokens
from verdigris.llm.exact_dedup import keep_one_of_each
from verdigris.llm.language_id import keep_known_languages
from verdigris.llm.mixing import mixed_documents
from verdigris.llm.near_dedup import keep_one_of_each_class

RANKS = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text a language model accepts, with all columns as they are.

    A text that is null, empty or without letters goes. Null ids and languages, repeated rows and further columns stay;
    rows without id or language are judged but not learnt from. An empty table stays empty.
    """
    return keep_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for the case of A-Z: that of the largest id, with all columns.

    A null text counts as empty; a null id loses to any other; of rows that repeat id and text one stays. An empty table stays empty.
    """
    return keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id, with all columns.

    A null text counts as empty and is like empty texts alone; a null id loses to any other; rows that share an id are judged by
    their own texts; of rows that repeat id and text one stays. An empty table stays empty.
    """
    return keep_one_of_each_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times), with all columns.

    A null source is a source of its own; a null or empty text has no words and is taken as its id's hash says; rows of one
    source and id are taken alike. An empty table stays empty.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``, a row for each row.

    A null or empty text has no tokens; ids may be null or repeat. An empty table stays empty.
    """
    return bpe_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens)]
#: SQL can express neither the models nor the tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

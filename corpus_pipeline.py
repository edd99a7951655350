"""From raw documents to token files: language ID, near-duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it again
for the next stage. All stages but the last return the columns of documents.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of clashing names are treated as the
operator of each stage says in its docstring; no stage fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import plumbline.llm.decontaminate as decontaminate
import plumbline.llm.langid as langid
import plumbline.llm.mixing as mixing
import plumbline.llm.overlap as overlap
import plumbline.llm.simhash as simhash
import plumbline.llm.tokenfile as tokenfile
from plumbline.llm.common import forget, held, written
from plumbline.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or made of nothing that the labelled ones show, go.

    Null and empty texts go, a text in several languages stays. Repeated rows and rows without a doc_id are judged each.
    """
    return langid.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    A group is joined by op2's links and by five-word similarities of 0.8 or more. Texts without words are copies of each
    other. Rows without a doc_id go; of rows that share one, one stays.
    """
    return simhash.keep_one(docs, overlap.similar_texts(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Those without a text hold none; repeated rows are judged each."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a null source is one of its own, ties go by a hash of the text."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in token files, as read back from these; a null text is the end id alone, repeated rows all stand."""
    return tokenfile.op5(docs, TOKENIZER)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-ID output", token_files),
]

#: Fingerprints, a trained model and tokenizers have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = held()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        forget(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

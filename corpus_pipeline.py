"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Language ID and the quality classifier drop what they reject, SimHash keeps one document of each group, and
decontamination drops contaminated documents; these stages return their input's columns unchanged. Packing returns
the pieces of the token sequences. Rows keep their own fate: repeated rows are judged alike, null texts are rejected
by language ID, and an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstack.llm import decontaminate, langid, packing, quality, simhash
from loomstack.llm.common import materialize, table
from loomstack.llm.queries import language_model, quality_model, tokenizer_path

#: Least probability of its best language that a text stays with: below it, on the check tables, about half are told wrong.
LANGUAGE = 0.9
#: Least quality score that stays: labels are as likely good as bad there.
QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, language_model(docs), least=LANGUAGE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality_model(docs, table(spark, sf_dir, "labels")), threshold=QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", clean),
    ("packing", packed),
]

#: SQL has neither the classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

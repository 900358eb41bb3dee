"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm import ann, chat, decontaminate, langid, packing, quality, sharding, simhash, token_counts, toxicity
from loomstack.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """crc32 of the document id as text, modulo n; null for no id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def held_out(n: int, rest: int) -> Column:
    return F.coalesce(fold(n) == rest, F.lit(False)).alias("held_out")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(every))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs, fold(5) != 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, language_model(docs)).select("doc_id", held_out(5, 0), "lang_pred", "score", "ambiguous")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.revise(table(spark, sf_dir, "documents"), token_counts.sample_revision(), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.score(docs, model).select("doc_id", held_out(4, 2), "score", "predicted")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels, fold(4) != 2)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out(4, 2), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_decontaminate,
        op2_chat_format,
        op3_simhash,
        op4_language_id,
        op5_token_counts,
        op6_ann,
        op7_toxicity,
        op8_sharding,
        op9_packing,
        op10_quality,
    )
    return {f.__name__: f for f in every}

"""The training-data queries of the driver: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, langid, markup, neardup, pii, quality, shards
from .shared import WORD_ROWS, key_crc, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(documents, bpe.Encoder(spark, vocabulary), keep=["doc_id"], check=True)
    return stored(bpe.digest(encoded), "encoded", batch_rows=WORD_ROWS)


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality.describe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    learnt = table(spark, sf_dir, "labels").where(~quality.folds(F.col("doc_id")))
    scored = quality.score(described, quality.train(described, learnt))
    return scored.select("doc_id", quality.folds(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return markup.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_windows(rows.unionAll(extra)))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(decontam.decontaminate(documents, table(spark, sf_dir, "benchmark")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.digest(found, pii.train(found))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(key_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = langid.train(documents.where(~held_out), F.col("doc_id"))
    return langid.predict(documents.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_kd_shards": op2_kd_shards,
    "op3_quality": op3_quality,
    "op4_main_text": op4_main_text,
    "op5_chat_format": op5_chat_format,
    "op6_nearest": op6_nearest,
    "op7_minhash": op7_minhash,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {
    "op5_chat_format": chat.SQL,
    "op7_minhash": neardup.SQL,
    "op8_decontamination": decontam.SQL,
}

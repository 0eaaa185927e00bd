"""A corpus pipeline: language ID, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
``documents``. Null and empty texts, repeated rows and empty tables are handled as the operators' modules say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, decontam, langid, neardup, pii
from citeloom.llm.shared import TEXT_ROWS, WORD_ROWS, fresh, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the rest carry the predicted one."""
    model = langid.train(docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))), F.col("doc_id"))
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    found = langid.predict(docs, model, into=(lang, score)).where(F.col(lang) != langid.UNDETERMINED)
    return stored(found.withColumn("lang", F.col(lang)).select(docs.columns), "language", batch_rows=TEXT_ROWS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the least doc_id stays."""
    return neardup.deduplicate(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return stored(found.where(F.size("hit_spans") == 0).select(docs.columns), "decontaminated", batch_rows=TEXT_ROWS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows."""
    model = pii.train(pii.detect(docs.select("doc_id", "text")))
    clean = pii.redact(docs, model)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the whole text, their number, and whether they decode to the text."""
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    marked = docs.select("doc_id", "lang", "source", "text", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_sum"))
    encoded = bpe.encode(marked, bpe.Encoder(spark, vocabulary), keep=["doc_id", "lang", "source", "_sum"], check=True)
    checked = encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.md5("decoded") == F.col("_sum")).alias("decodes"))
    return stored(checked, "pipeline-ids", batch_rows=WORD_ROWS)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("tokens", encode),
]

#: Learned language filters, similarity components and weak supervision have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

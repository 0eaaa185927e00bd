"""Helpers of the training-data operators that hold Spark state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch

_BATCH_ROWS, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an Arrow batch that suit whole texts: buffers on both sides stay small, however long the session has run.
TEXT_ROWS = 1000
#: The same for jobs with two Python workers a task, which get texts as lists of words.
WORD_ROWS = 250
#: Bytes of an Arrow batch where rows may be long: Spark's 64 MB and their growth lie beside the heap, for each task.
LONG_BYTES = 4 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int | None, size: int | None = None) -> Iterator[None]:
    """Jobs that start in here use Arrow batches of at most ``rows`` and about ``size`` bytes; the session's settings come back afterwards."""
    before, before_size = spark.conf.get(_BATCH_ROWS), spark.conf.get(_BATCH_BYTES)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    if size and (before_size.startswith("-") or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before_size) <= size):
        spark.conf.set(_BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)
        spark.conf.set(_BATCH_BYTES, before_size)


def stored(df: DataFrame, name: str, batch_rows: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    ``batch_rows``, ``batch_bytes``: rows and bytes of the job's Arrow batches at most.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, batch_rows, batch_bytes):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(text) -> F.col:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def key_crc(doc_id) -> F.col:
    """CRC-32 of the decimal id: the folds of the contracts are remainders of it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Incremental indexing of a stream of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import PaperIndex


def upsert_stream(papers: DataFrame, index: PaperIndex, checkpoint: str, order: str = "ordinal") -> StreamingQuery:
    """Each micro-batch is upserted; a batch that is tried again finds its papers indexed and adds none."""

    def write(batch: DataFrame, _: int) -> None:
        index.upsert(batch, F.col(order))

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

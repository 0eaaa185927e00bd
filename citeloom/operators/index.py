"""The paper index as a versioned Parquet table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def missing(papers: DataFrame, index: DataFrame, key: str = "paper_id") -> DataFrame:
    """Papers that aren't indexed yet."""
    return papers.join(index.select(key), key, "left_anti")


def last_wins(papers: DataFrame, order: Column, key: str = "paper_id") -> DataFrame:
    """Of rows with the same key the one that came last."""
    rest = [c for c in papers.columns if c != key]
    return papers.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def point(papers: DataFrame) -> DataFrame:
    """``papers`` (paper_id, title, abstract, ...) with point_id and the encoder's input."""
    return papers.withColumn("point_id", text.uuid5(F.col("paper_id").cast("string"))).withColumn("passage", text.passage(F.col("title"), F.col("abstract")))


def encoded(rows: DataFrame, encoder: Callable[[list[str]], tuple[list[list[float]], list[dict[int, float]]]], size: int = 64) -> DataFrame:
    """``rows`` with ``dense`` and ``sparse`` of each passage. ``encoder``: a list of at most ``size`` passages -> its dense and sparse vectors."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            dense, sparse = [], []
            for i in range(0, len(column), size):
                one, other = encoder(column.slice(i, size).to_pylist())
                dense += [list(map(float, x)) for x in one]
                sparse += [[(int(t), float(w)) for t, w in x.items()] for x in other]
            yield pa.StructArray.from_arrays([pa.array(dense, pa.list_(pa.float32())), pa.array(sparse, pa.map_(pa.int32(), pa.float32()))], names=["dense", "sparse"])

    encode = F.arrow_udf(run, "struct<dense:array<float>,sparse:map<int,float>>").asNondeterministic()
    return rows.withColumn("_encoded", encode("passage")).select(*rows.columns, "_encoded.dense", "_encoded.sparse")


class PaperIndex:
    """A table of points. ``encode``: DataFrame -> DataFrame, adds the vectors to the rows that are new."""

    def __init__(self, spark: SparkSession, name: str, encode=lambda rows: rows):
        self.spark, self.name, self.encode = spark, name, encode

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, schema: str) -> bool:
        """Whether the table had to be made."""
        if self.exists():
            return False
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet")
        return True

    def table(self, spark: SparkSession | None = None) -> DataFrame:
        """The table as it is now, also after another session has written to it."""
        spark = spark or self.spark
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name)

    def count(self) -> int:
        return self.table().count()

    def upsert(self, papers: DataFrame, order: Column) -> tuple[int, int]:
        """Add the papers that are new; returns (rows sent, rows stored)."""
        table = self.table(papers.sparkSession)
        new = missing(papers, table)
        sent = new.count()
        rows = self.encode(point(last_wins(new, order)))
        stored_before = table.count()
        rows.select(*table.columns).write.insertInto(self.name)
        return sent, self.count() - stored_before

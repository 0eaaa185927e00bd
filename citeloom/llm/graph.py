"""Connected components and id filters without gathering ids on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Logarithm of the id filter's bits: 2 MB whatever the number of ids. More ids only let more others through.
FILTER_LOG = 24


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b): the root is the least id of the component.

    Each round points every vertex at its least neighbour, follows the pointers twice, and contracts the edges; a
    star is done in one round and any other shape in a number of rounds that grows with the logarithm of its size.
    """
    roots = None
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("root")), "parents")
        for _ in range(2):
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("top"))
            parent = parent.join(up, "root").select("id", F.col("top").alias("root"))
        parent = stored(parent, "parents")
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("top"))
            roots = stored(roots.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")
        for end in ("a", "b"):
            left = left.join(parent.select(F.col("id").alias(end), "root"), end).drop(end).withColumnRenamed("root", end)
        left = stored(left.where("a <> b").distinct(), "edges")
    return left.select(F.col("a").alias("id"), F.col("b").alias("root")) if roots is None else roots


def _place(column) -> F.col:
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_LOG)) + 1


def _bits(ids: DataFrame, column: str) -> bytes:
    at = _place(F.col(column))
    parts = ids.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    size = 32768 // 8
    out = bytearray((1 << FILTER_LOG) // 8)
    for r in parts:
        out[(r["bucket"] - 1) * size : r["bucket"] * size] = r["bits"]
    return bytes(out)


def _sieve(shared, want: bool):
    def run(places: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for place in places:
            at = place.to_numpy() - 1
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield pa.array(hit.astype(bool) == want)

    return run


def sieve(rows: DataFrame, ids: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows whose id may be one of ``ids`` (or, not ``inside``, surely is none), by a bitmap of fixed size: no shuffle.

    Only a hash of the id goes through Python. Rows with a null id are hashed like any other value.
    """
    test = F.arrow_udf(_sieve(rows.sparkSession.sparkContext.broadcast(_bits(ids, column)), inside), "boolean")
    return rows.where(test(_place(F.col(column))))


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not one of ``ids``; only those that the bitmap doesn't clear are shuffled."""
    return sieve(rows, ids, column, inside=False).unionAll(sieve(rows, ids, column).join(ids.select(column).distinct(), column, "left_anti").select(rows.columns))

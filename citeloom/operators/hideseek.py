"""Hide-and-seek examples: coverage gate and held-out references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE, HIDE_FRACTION = 0.7, 0.3


def coverage(indexed: Column, total: Column) -> Column:
    """indexed / total; without a total, 1 if something is indexed and else 0."""
    return F.when(total > 0, indexed / total).otherwise(F.when(indexed > 0, 1.0).otherwise(0.0))


def hidden_size(n: Column, fraction: float = HIDE_FRACTION) -> Column:
    """How many of n references are hidden: the fraction, half to even, one at least."""
    if fraction < 0:
        raise ValueError("the fraction must not be negative")
    if fraction == 0:
        return F.lit(0)
    return F.when(n > 0, F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(fraction).cast("double"), 0).cast("int")))).otherwise(0)


def hidden(references: Column, row_id: Column, seed: int = 42, fraction: float = HIDE_FRACTION) -> Column:
    """The hidden part of an array of ids, as a sorted array: drawn by the least hashes of seed, row and id, so the same in any partitioning."""
    distinct = F.array_distinct(F.coalesce(references, F.array().cast("array<string>")))
    keyed = F.array_sort(F.transform(distinct, lambda r: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), r)).alias("key"), r.alias("id"))))
    return F.array_sort(F.transform(F.slice(keyed, F.lit(1), hidden_size(F.size(distinct), fraction)), lambda s: s["id"]))


def examples(rows: DataFrame, min_coverage: float = MIN_COVERAGE, fraction: float = HIDE_FRACTION, seed: int = 42) -> DataFrame:
    """``rows`` (example_id, indexed_reference_ids, total_reference_count, ...) that pass the gate, with hidden_paper_ids.

    Rows without a list are dropped; a missing total is the list's length, repeats included.
    """
    ids = F.col("indexed_reference_ids")
    total = F.coalesce("total_reference_count", F.size(ids))
    gated = rows.where(ids.isNotNull()).where(coverage(F.size(ids), total) >= min_coverage)
    return gated.withColumn("hidden_paper_ids", hidden(ids.cast("array<string>"), F.col("example_id"), seed, fraction))

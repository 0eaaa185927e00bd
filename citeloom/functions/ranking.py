"""Column functions on a ranked array of ids and an array of relevant ids. Null arrays count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ids(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _hits(ranked: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(_ids(ranked), 1, max(k, 0)), _ids(relevant)))


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    n = F.size(F.array_distinct(_ids(relevant)))
    return F.coalesce(F.try_divide(_hits(ranked, relevant, k), n), F.lit(0.0))


def precision_at(ranked: Column, relevant: Column, k: int) -> Column:
    return F.lit(0.0) if k <= 0 else _hits(ranked, relevant, k) / F.lit(k)


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    """1 / rank of the first hit in the whole list."""
    at = F.array_min(F.filter(F.transform(_ids(relevant), lambda r: F.array_position(_ids(ranked), r)), lambda p: p > 0))
    return F.coalesce(F.lit(1.0) / at, F.lit(0.0))


def ndcg_at(ranked: Column, relevant: Column, k: int = 10) -> Column:
    """Binary gains, each id counted where it stands first; repeats keep their places."""
    if k <= 0:
        return F.lit(0.0)
    wanted, top = F.array_distinct(_ids(relevant)), F.slice(_ids(ranked), 1, k)
    gain = lambda a, p: a + F.lit(1.0) / F.log2(p + 1)
    places = F.array_sort(F.filter(F.transform(wanted, lambda r: F.array_position(top, r)), lambda p: p > 0))
    best = F.least(F.size(wanted), F.lit(k))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(F.array().cast("array<int>")), F.lit(0.0), gain)
    return F.coalesce(F.try_divide(F.aggregate(places, F.lit(0.0), gain), ideal), F.lit(0.0))


def per_example(ranked: Column, relevant: Column, ks: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """recall@k and precision@k of every k, mrr, and ndcg@10."""
    return [
        *(f(ranked, relevant, k).alias(f"{name}_at_{k}") for k in ks for name, f in (("recall", recall_at), ("precision", precision_at))),
        reciprocal_rank(ranked, relevant).alias("mrr"), ndcg_at(ranked, relevant, 10).alias("ndcg_at_10"),
    ]

"""Retrieval evaluation: metrics of each example, strata in one pass, and paired bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking

KS = (1, 5, 10)
METRICS = (*(f"{m}_at_{k}" for k in KS for m in ("recall", "precision")), "mrr", "ndcg_at_10")


def ranked_lists(ranked: DataFrame) -> DataFrame:
    """query_id and ``ranked``, the ids as strings in order of rank."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("id"))))
    return ranked.groupBy("query_id").agg(F.transform(pairs, lambda p: p["id"]).alias("ranked"))


def per_example(examples: DataFrame, rankings: DataFrame) -> DataFrame:
    """A row for each example (query_id, relevant, ...): its metrics, hidden_count and skipped (nothing to find)."""
    joined = examples.join(rankings, "query_id", "left")
    kept = [c for c in examples.columns if c != "relevant"]
    n = F.size(F.array_distinct(F.coalesce("relevant", F.array().cast("array<string>"))))
    measured = joined.select(*kept, n.cast("long").alias("hidden_count"), (n == 0).alias("skipped"), *ranking.per_example(F.col("ranked"), F.col("relevant"), KS))
    return measured.select(*kept, "hidden_count", "skipped", *(F.round(m, 9).alias(m) for m in METRICS))


def summary(measured: DataFrame, strata: tuple[str, ...] = ("section", "intent", "facet")) -> DataFrame:
    """stratum_type, stratum, n and mean metrics over the examples that weren't skipped: overall and by each stratum, in one pass."""
    named = measured.where("not skipped")
    for s in strata:
        named = named.withColumn(s, F.coalesce(F.nullif(F.col(s).cast("string"), F.lit("")), F.lit("UNKNOWN")))
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    grouped = named.groupingSets([[], *([F.col(s)] for s in strata)], *(F.col(s) for s in strata)).agg(F.count("*").alias("n"), *(F.grouping(s).alias(f"_{s}") for s in strata), *means)
    kind = F.lit("overall")
    value = F.lit("all")
    for s in strata:
        kind, value = F.when(F.col(f"_{s}") == 0, s).otherwise(kind), F.when(F.col(f"_{s}") == 0, F.col(s)).otherwise(value)
    return grouped.select(kind.alias("stratum_type"), value.alias("stratum"), "n", *METRICS)


def facet(is_multi) -> F.col:
    return F.when(is_multi.isNull(), "unknown").otherwise(F.when(is_multi, "multi").otherwise("single"))


def numbered(rows: DataFrame, key: str, pieces: int = 64) -> DataFrame:
    """``rows`` (stored) with ``i`` from 0 in order of ``key``: numbers within ranges of the key, after the totals of the ranges before."""
    bounds = rows.select(F.percentile_approx(key, [j / pieces for j in range(1, pieces)], 10000).alias("b")).first()["b"] or []
    piece = F.size(F.filter(F.array(*(F.lit(b) for b in sorted(set(bounds)))), lambda b: b < F.col(key))) if bounds else F.lit(0)
    placed = rows.withColumn("_piece", piece)
    totals = placed.groupBy("_piece").agg(F.count("*").alias("n"))
    before = totals.select("_piece", (F.sum("n").over(Window.orderBy("_piece")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(key))
    return placed.withColumn("_n", within).join(F.broadcast(before), "_piece").withColumn("i", F.col("_before") + F.col("_n") - 1).drop("_piece", "_before", "_n")


def paired_bootstrap(pairs: DataFrame, n_boot: int = 2000, alpha: float = 0.05, seed: int = 13) -> DataFrame:
    """One row over ``pairs`` (i from 0 without gaps, a, b): means, percentile interval of the mean difference, two-sided p.

    Draw j of resample r is the row md5(seed|r|j) modulo n, so that any engine draws the same. The draws are joined
    with the differences, not the other way round; nothing is collected.
    """
    if n_boot <= 0:
        raise ValueError("n_boot must be positive")
    stats = pairs.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"))
    spark = pairs.sparkSession
    draws = spark.range(n_boot).withColumnRenamed("id", "r").join(F.broadcast(stats)).where("n > 0").select("r", "n", "mean_diff", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("j").cast("string")))
    drawn = draws.withColumn("i", F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("n"))
    means = drawn.join(pairs.select("i", (F.col("a") - F.col("b")).alias("d")), "i").groupBy("r", "mean_diff").agg(F.round(F.avg("d"), 9).alias("m"))
    low, high = int(alpha / 2 * n_boot), min(n_boot - 1, max(0, int((1 - alpha / 2) * n_boot)))
    ranked = F.array_sort(F.collect_list("m"))  # n_boot numbers
    extreme = F.count_if(F.abs(F.col("m") - F.round("mean_diff", 9)) >= F.abs(F.round("mean_diff", 9)))
    spread = means.agg(F.get(ranked, F.lit(low)).alias("ci_low"), F.get(ranked, F.lit(high)).alias("ci_high"), extreme.alias("extreme"))
    p = F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), (F.col("extreme") + 1) / F.lit(n_boot + 1)))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 9).alias(c)
    return stats.join(F.broadcast(spread)).select(zero("mean_a"), zero("mean_b"), zero("mean_diff"), zero("ci_low"), zero("ci_high"), F.round(p, 9).alias("p_value"), F.lit(n_boot).cast("long").alias("n_boot"))

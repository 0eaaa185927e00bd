"""Citation graph: hops from seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hop_roles(citations: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """paper_id and role (seed, hop1, hop2, ...): the fewest citations from a seed. ``citations``: source, target."""
    found = seeds.select("paper_id").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for hop in range(1, hops + 1):
        reached = citations.join(frontier.select(F.col("paper_id").alias("source")), "source", "left_semi").select(F.col("target").alias("paper_id")).distinct()
        frontier = reached.join(found.select("paper_id"), "paper_id", "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(frontier)
    return found.select("paper_id", F.when(F.col("hop") == 0, "seed").otherwise(F.concat(F.lit("hop"), F.col("hop").cast("string"))).alias("role"))

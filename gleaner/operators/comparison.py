"""How close the results of one run come to another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_results(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per query the share of the first `k` both runs have, then the averages; one row."""
    def tops(r: DataFrame, side: str) -> DataFrame:
        best = r.filter(F.col("rank") <= k).select("query", F.struct("rank", "id").alias("x"))
        ordered = F.array_sort(F.collect_list("x"))  # at most k per query
        return best.groupBy("query").agg(F.transform(ordered, lambda x: x["id"]).alias(side))

    both = tops(a, "_a").join(tops(b, "_b"), "query")
    shared = F.size(F.array_intersect("_a", "_b")) / F.lit(k)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg(shared).alias(f"top{k}_overlap"),
        F.count_if(F.get("_a", F.lit(0)).eqNullSafe(F.get("_b", F.lit(0)))).alias("same_top1"),
        F.count_if(F.array_sort("_a") == F.array_sort("_b")).alias("same_set"),
    )

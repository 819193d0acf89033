"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node of `edges` (a, b) that is not a root itself.

    Each round hangs neighbours on the least node seen, first the larger ones, then the smaller; rounds are few
    (the logarithm of the longest chain) and each ends in a checkpoint. Loops and repeated edges change nothing.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now)
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

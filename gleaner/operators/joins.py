"""A lookup join that stays balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: str, weight: str, spread: Sequence[Column], hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Left join `rows` to `lookup` (one row per key, `weight` = how many rows hold the key).

    The `hot_keys` heaviest keys are broadcast (a fixed number of rows); whatever is not among them holds at
    most 1/hot_keys of the data. Rows already answered are spread by `spread` over the shuffle of the rest.
    """
    values = [c for c in lookup.columns if c != on]
    hot = lookup.orderBy(F.desc(weight), on).limit(hot_keys)
    hot = hot.select(on, F.struct(*values).alias("_hot"))
    cold = lookup.select(on, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(65536)).cast("int") + 1).otherwise(0)
    )
    joined = marked.join(cold, [on, "_salt"], "left")
    kept = [c for c in rows.columns]
    found = F.coalesce("_hot", "_cold")
    return joined.select(*kept, *[found[v].alias(v) for v in values])

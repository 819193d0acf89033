"""Ranks, running sums and neighbours over groups of any size.

A plain window puts each group into one task. Here rows are range-partitioned by (keys, order), so one
group may span many partitions; every partition is numbered on its own and a table with one row per
(partition, key) carries what the earlier partitions contribute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import broadcast_if_small, cut_lineage

PART, POS = "_part", "_pos"
_POS_BITS = (1 << 33) - 1


def stable_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """`df` in (keys, order) order across partitions, fixed by a checkpoint, with partition and position."""
    cols = [F.col(k) for k in keys] + list(order)
    ordered = cut_lineage(df.repartitionByRange(*cols).sortWithinPartitions(*cols))
    return ordered.select(
        "*",
        F.spark_partition_id().alias(PART),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_BITS)).alias(POS),
    )


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[f"_r{c}"])
    return cond


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [PART, *keys]
    carry = carry.select(*[F.col(c).alias(f"_r{c}") for c in on], *[c for c in carry.columns if c not in on])
    carry = broadcast_if_small(carry)
    return rows.join(carry, _same(rows, carry, on), "left").drop(*[f"_r{c}" for c in on])


def _earlier(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """1, 2, 3… within each key, in `order` (which must be total)."""
    rows = stable_sorted(df, keys, order)
    parts = rows.groupBy(PART, *keys).agg(F.min(POS).alias("_first"), F.count(F.lit(1)).alias("_n"))
    carry = parts.select(
        PART, *keys, (F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return (
        _with_carry(rows, carry, keys)
        .withColumn(out, (F.col(POS) + F.col("_shift")).cast("bigint"))
        .drop(PART, POS, "_shift")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add for each (new column, source column) the sum of the source up to and including the row."""
    rows = stable_sorted(df, keys, order)
    parts = rows.groupBy(PART, *keys).agg(*[F.sum(src).alias(f"_s_{out}") for out, src in sums.items()])
    carry = parts.select(
        PART, *keys, *[F.coalesce(F.sum(f"_s_{o}").over(_earlier(keys)), F.lit(0)).alias(f"_c_{o}") for o in sums]
    )
    local = Window.partitionBy(PART, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(src).over(local).alias(f"_l_{out}") for out, src in sums.items()])
    rows = _with_carry(rows, carry, keys)
    for out in sums:
        rows = rows.withColumn(out, F.col(f"_l_{out}") + F.col(f"_c_{out}")).drop(f"_l_{out}", f"_c_{out}")
    return rows.drop(PART, POS)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Columns of the previous (`lag`) and next (`lead`) row of the same key, across partitions."""
    lag, lead = lag or {}, lead or {}
    rows = stable_sorted(df, keys, order)
    local = Window.partitionBy(PART, *keys).orderBy(POS)
    across = Window.partitionBy(*keys).orderBy(PART)
    firsts = F.min_by(F.struct(*[F.col(c).alias(o) for o, c in lead.items()]), POS) if lead else F.lit(None)
    lasts = F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lag.items()]), POS) if lag else F.lit(None)
    parts = rows.groupBy(PART, *keys).agg(firsts.alias("_firsts"), lasts.alias("_lasts"))
    carry = parts.select(
        PART, *keys,
        F.lead("_firsts").over(across).alias("_next"),
        F.lag("_lasts").over(across).alias("_prev"),
    )
    here = F.struct(F.lit(True).alias("_in"), *[F.col(c) for c in {*lag.values(), *lead.values()}])
    rows = rows.select("*", F.lag(here).over(local).alias("_before"), F.lead(here).over(local).alias("_after"))
    rows = _with_carry(rows, carry, keys)
    for side, edge, cols in (("_before", "_prev", lag), ("_after", "_next", lead)):
        for out, src in cols.items():
            inside = F.col(f"{side}.{src}")
            rows = rows.withColumn(
                out, F.when(F.col(f"{side}._in"), inside).otherwise(F.col(f"{edge}.{out}"))
            )
    return rows.drop(PART, POS, "_before", "_after", "_prev", "_next")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First `k` rows per key; Spark limits each group to k rows before the shuffle, so no group grows."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k).withColumn(
        out, F.col(out).cast("bigint")
    )

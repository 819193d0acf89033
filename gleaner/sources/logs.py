"""Append-only JSON logs: broken lines are dropped, the last row of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with `_file` and `_line` telling where they stood, as files have no order of their own in Spark."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")
    )
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (
        lines.filter(F.trim("value") != "")
        .filter(F.try_parse_json("value").isNotNull())
        .select(row.alias("r"), "_file", "_line").filter(F.col("r").isNotNull()).select("r.*", "_file", "_line")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row per key by an explicit order; map-side combined, so a busy key costs one row per task."""
    values = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return picked.select(*keys, "_last.*")


def compact_log(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """One row per key: the last one written."""
    return latest(read_log(spark, path, schema), [key], ["_file", "_line"]).drop("_file", "_line")

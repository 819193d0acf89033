"""Labeled queries: `query,file1;file2`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import strip


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query, files) rows of a CSV with a heading; files may be missing."""
    rows = spark.read.csv(path, schema="query string, files string", header=True, multiLine=True, enforceSchema=True,
                          quote='"', escape='"')
    return rows.select(strip(F.regexp_replace("query", "^\\x{feff}", "")).alias("query"), "files").filter(
        F.coalesce("query", F.lit("")) != "")


def resolve_qrels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(query, name, relevant, status) per named file: found, or unknown when it fits none or several.

    A query with no name at all keeps one row of status "unlabeled".
    """
    files = F.transform(F.split(F.coalesce("files", F.lit("")), "[;；]"), lambda s: F.replace(strip(s), F.lit("\\"), F.lit("/")))
    named = rows.select("query", F.explode_outer(F.filter(files, lambda s: s != "")).alias("name"))
    exact = known.groupBy("relpath").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(
        F.col("relpath").alias("name"), F.col("relpath").alias("_exact"))
    base = known.groupBy(F.substring_index("relpath", "/", -1).alias("name")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("relpath").alias("_base")).filter("_n = 1").drop("_n")
    blank = named.filter(F.col("name").isNull())  # kept out of the joins: all would meet in one task
    found = named.filter(F.col("name").isNotNull()).join(exact, "name", "left").join(base, "name", "left")
    found = found.unionByName(blank.select("query", "name", *[F.lit(None).cast("string").alias(c) for c in ("_exact", "_base")]))
    relevant = F.coalesce("_exact", "_base")
    status = F.when(F.col("name").isNull(), "unlabeled").when(relevant.isNull(), "unknown").otherwise("found")
    return found.select("query", "name", relevant.alias("relevant"), status.alias("status"))


def qrels(resolved: DataFrame) -> DataFrame:
    return resolved.filter("status = 'found'").select("query", "relevant").distinct()


def unlabeled(resolved: DataFrame) -> DataFrame:
    """Queries none of whose files could be told."""
    return resolved.groupBy("query").agg(F.count_if(F.col("status") == "found").alias("_n")).filter("_n = 0").select("query")

"""A corpus of files: what is there, what is the same, what cannot be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.joins import lookup_join
from gleaner.session import cut_lineage

# What counts as a picture, by name and by its first bytes.
IMAGE_EXTS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "heic", "heif")
MAGIC = (
    ("JPEG", "^FFD8FF"), ("PNG", "^89504E470D0A1A0A"), ("GIF", "^474946383[79]61"),
    ("WEBP", "^52494646.{8}57454250"), ("BMP", "^424D"), ("HEIF", "^.{8}66747970(68656963|68656978|6D696631|6D736631|68657663)"),
)


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def file_format(content: Column, magic: Sequence[tuple[str, str]] = MAGIC) -> Column:
    """Format by first bytes, null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(*[F.when(head.rlike(pattern), F.lit(name)) for name, pattern in magic])


def read_files(spark: SparkSession, source: str) -> DataFrame:
    """All files under a folder, with their path relative to it. Only listed columns are kept in a plan."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    root = source.rstrip("/").split("://")[-1] + "/"
    rel = F.substring_index("path", root, -1)
    return df.select(
        F.lit(source).alias("source"), rel.alias("relpath"), "path", F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"), "content",
    )


def dedup_by_content(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Add `first` (the `name` of the first row with the same key) and `is_duplicate`.

    The first row of each key is an aggregate; rows learn it through a join that spreads keys with many copies.
    """
    place = F.struct(F.struct(*order).alias("place"), F.col(name).alias("name"))
    firsts = df.groupBy(key).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    joined = lookup_join(df, firsts, key, "_copies", [F.col(c) for c in {*order, name}])
    return joined.select(
        *df.columns, F.col("_first.name").alias("first"), (place != F.col("_first")).alias("is_duplicate")
    )


def scan_corpus(
    spark: SparkSession,
    sources: Sequence[str],
    exts: Sequence[str] = IMAGE_EXTS,
    readable: Callable[[bytes], bool] | None = None,
    magic: Sequence[tuple[str, str]] = MAGIC,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per file under the folders `sources`, as `classify` gives them."""
    files = reduce(
        DataFrame.unionByName,
        [read_files(spark, s).withColumn("source_pos", F.lit(i)) for i, s in enumerate(sources)],
    )
    return classify(files, exts, readable, magic, max_bytes)


def classify(
    files: DataFrame,
    exts: Sequence[str] = IMAGE_EXTS,
    readable: Callable[[bytes], bool] | None = None,
    magic: Sequence[tuple[str, str]] = MAGIC,
    max_bytes: int | None = None,
) -> DataFrame:
    """Each file (source_pos, source, relpath, path, size, mtime, content) as ok, duplicate (with the file it repeats),
    skipped or unreadable.

    `readable` may decode the bytes; without it the first bytes decide. Files beyond `max_bytes` are unreadable.
    """
    # the bytes of files nobody asked for, or too large to be one, are never read
    wanted = F.lower(F.substring_index("relpath", ".", -1)).isin(*exts) & F.contains("relpath", F.lit("."))
    fits = wanted if max_bytes is None else wanted & (F.col("size") <= max_bytes)
    small, rest = files.filter(fits), files.filter(~fits).drop("content")
    sound = file_format(F.col("content"), magic).isNotNull()
    if readable is not None:
        check = _validator(readable)
        sound = sound & F.coalesce(check(F.when(sound, F.col("content"))), F.lit(False))
    place = ["source_pos", "source", "relpath", "path", "size", "mtime"]
    read = small.select(*place, F.lit(True).alias("_wanted"), sound.alias("_sound"), content_id(F.col("content")).alias("id"))
    read = cut_lineage(read)  # every file is read and hashed once
    good = dedup_by_content(read.filter("_sound"), "id", ["source_pos", "relpath"], "path")
    unread = rest.select(*place, wanted.alias("_wanted"), F.lit(False).alias("_sound"), F.lit(None).cast("string").alias("id"))
    bad = read.filter("NOT _sound").unionByName(unread).select(
        "*", F.lit(None).cast("string").alias("first"), F.lit(False).alias("is_duplicate")
    )
    status = (
        F.when(~F.col("_wanted"), "skipped").when(~F.col("_sound"), "unreadable")
        .when(F.col("is_duplicate"), "duplicate").otherwise("ok")
    )
    return good.unionByName(bad).select(
        "id", "source", "relpath", "path", "size", "mtime", status.alias("status"),
        F.when(F.col("is_duplicate"), F.col("first")).alias("duplicate_of"),
    )


def _validator(readable: Callable[[bytes], bool]):
    @F.pandas_udf("boolean")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            yield pd.Series([None if c is None else _safe(readable, c) for c in contents], dtype="object")

    return check


def _safe(readable: Callable[[bytes], bool], content: bytes) -> bool:
    try:
        return bool(readable(content))
    except Exception:
        return False


def scan_report(scanned: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row of counts; `sources` (source) adds how many of them hold no file."""
    counts = scanned.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "duplicate", "skipped", "unreadable")])
    if sources is None:
        return counts
    missing = sources.join(scanned.select("source").distinct(), "source", "left_anti")
    return counts.crossJoin(missing.agg(F.count(F.lit(1)).alias("missing_sources")))  # two single rows


def source_signature(files: DataFrame) -> DataFrame:
    """(source, files, bytes, newest): cheap to compare with the last run."""
    return files.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest")
    )


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, change): added, removed or changed."""
    fields = ["files", "bytes", "newest"]
    b = before.select("source", F.struct(*fields).alias("_b"))
    a = after.select("source", F.struct(*fields).alias("_a"))
    change = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed").alias("change")
    )
    return b.join(a, "source", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("source", change)

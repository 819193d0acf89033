"""Streams of files, decisions, events and documents. Each gives what its batch twin gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import lexical


FAR = datetime(2200, 1, 1)
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    """New files of a folder as they appear."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(source)


def read_table(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """`stream` together with the rows of a folder that stays empty until `end` is called; put it before a watermark."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def end(spark: SparkSession, schema, folder: str, ts: str = "ts", at: datetime = FAR, **values) -> None:
    """Say that nothing more will come: one row at a far time, whose other columns are null but for `values`.

    It moves the watermark past all that is open, so the next run with the same state gives out every window and
    session that is left. The row's own stay open and are never given out; events that come later are dropped.
    """
    row = {f.name: None for f in schema} | values | {ts: at}
    spark.createDataFrame([tuple(row[f.name] for f in schema)], schema).write.mode("append").parquet(folder)


def append_to(stream: DataFrame, path: str, state: str, available_now: bool = True, interval: str = "20 seconds") -> StreamingQuery:
    """Write final rows as Parquet; `available_now` drains what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def each_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], state: str, mode: str = "append",
    available_now: bool = True, interval: str = "20 seconds",
) -> StreamingQuery:
    """Run `fn(batch, number)`; a batch that is repeated after a failure has the same number."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", state).outputMode(mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def updates_to(stream: DataFrame, path: str, state: str, **kwargs) -> StreamingQuery:
    """Write each batch's changed rows to a folder of its own; `latest_updates` reads the present values."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each_batch(stream, write, state, "update", **kwargs)


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    values = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(key, "_v.*")


def bursts(stream: DataFrame, quiet: str = "3 seconds", delay: str = "0 seconds") -> DataFrame:
    """(source, start, end, n): changes of a source with no more than `quiet` between them are one run."""
    w = F.session_window("ts", quiet)
    counted = stream.withWatermark("ts", delay).groupBy("source", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_arrivals(stream: DataFrame, keys: list[str], within: str) -> DataFrame:
    """The same content received again within the time is stored once; its sources are another branch."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def decisions_now(stream: DataFrame) -> DataFrame:
    """(id, decision, at, seq) whenever an id's latest decision changes (update mode)."""
    last = F.max_by(F.struct("decision", "at", "seq"), F.struct("at", "seq"))
    return stream.groupBy("id").agg(last.alias("_d")).select("id", "_d.*")


def last_seen(stream: DataFrame) -> DataFrame:
    return stream.groupBy("id").agg(F.max("at").alias("at"))


def search_rates(stream: DataFrame, every: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """(start, searches, acts, acted_rate) per window, once it can no longer change."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w")).agg(
        F.count_if(F.col("type") == "search").alias("searches"), F.count_if(F.col("type") == "act").alias("acts"))
    rate = F.when(F.col("searches") > 0, F.col("acts") / F.col("searches"))
    return counted.select(F.col("w.start").alias("start"), "searches", "acts", rate.alias("acted_rate"))


def live_match(
    stream: DataFrame, queries: DataFrame, index: str, matches: str, state: str, floor: float = 0.5, **kwargs
) -> StreamingQuery:
    """New documents become findable batch by batch, and standing queries are told of those that match.

    A batch adds its postings, how many of its documents hold each gram, and how many documents it has. Weights
    are sums of these counts, the batch's own included, so earlier postings are not read again.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        written = f"{index}/postings/batch={number}"
        lexical.document_grams(batch).write.mode("overwrite").parquet(written)
        grams = spark.read.schema(f"id {batch.schema['id'].dataType.simpleString()}, gram string").parquet(written)
        grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{index}/counts/batch={number}")
        lexical.corpus_size(batch).write.mode("overwrite").parquet(f"{index}/sizes/batch={number}")
        wanted = lexical.query_grams(queries)
        asked = wanted.select("gram").distinct()
        counts = spark.read.parquet(f"{index}/counts").join(asked, "gram", "left_semi")
        size = spark.read.parquet(f"{index}/sizes").agg(F.sum("n").alias("n"))
        weights = lexical.weigh(counts.groupBy("gram").agg(F.sum("df").alias("df")), size)
        scored = lexical.score_hits(wanted, grams.join(asked, "gram", "left_semi"), weights, size)
        scored.filter(F.round("share", 12) >= floor).write.mode("overwrite").parquet(f"{matches}/batch={number}")

    return each_batch(stream, run, state, **kwargs)

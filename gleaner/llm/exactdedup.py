"""Exact dedup as a stream: keyed state on disk, kept for ever, holds each digest's keeper and where its text is.

DataFrame functions alone. The stream groups digests in a RocksDB state store without a watermark, so nothing
expires and a later run with the same state goes on where the last one ended. A digest is only a hint: the bytes of
all texts of a digest are compared, and digests that hold different texts are split by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# state is on disk, and a task lets go of it as soon as it is committed: a run drains what there is and ends
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def update_state(
    spark: SparkSession, path: str, schema: StructType, root: str, id: str = "doc_id", text: str = "text",
    digest=sha256_of, files_per_batch: int = 10_000,
) -> DataFrame:
    """Bring the state under `root` up to date with the files at `path`: (digest, keep_id, locator, group_size).

    Files already read by an earlier call with this `root` are not read again. A batch gives out the digests whose
    state it changed; the last one counts. A repeated batch overwrites its own folder.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    files = f"{parent}/[{name[0]}]{name[1:]}"  # as a pattern: a stream takes a single file no other way
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = stream.select(digest(normalised(F.col(text))).alias("digest"), F.col(id).alias("id"), place.alias("locator"))
    state = rows.groupBy("digest").agg(
        F.min("id").alias("keep_id"), F.min_by("locator", F.struct(F.col("id").isNull(), "id", "locator")).alias("locator"),
        F.count(F.lit(1)).alias("group_size"),
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/keepers/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        started = state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
        started.foreachBatch(save).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.parquet(f"{root}/keepers")
    if found.select("batch").distinct().limit(2).count() > 1:
        last = F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("k")
        found = found.groupBy("digest").agg(last).select("digest", "k.*")
    return found.select("digest", "keep_id", "locator", "group_size")


def dedup(
    spark: SparkSession, path: str, root: str, id: str = "doc_id", text: str = "text", digest=sha256_of,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """Every row of the Parquet table at `path`: (id, keep_id, group_size, kept, text_sha256, keeper = file and row).

    Of equal normalised texts the row with the smallest id stays; a null id never is the smallest, and where all ids
    of a group are null keep_id is null. Rows that repeat the keeper's id are kept like it. Null texts count as
    empty, and empty texts equal each other. An empty table gives no rows. Other columns are not read.
    """
    docs = spark.read.parquet(path)
    if not docs.take(1):
        key = docs.schema[id].dataType.simpleString()
        return spark.createDataFrame([], f"id {key}, keep_id {key}, group_size bigint, kept boolean, text_sha256 string, keeper struct<file:string,row:bigint>")
    keepers = update_state(spark, path, docs.schema, root, id, text, digest, files_per_batch)
    rows = docs.select(F.col(id).alias("id"), normalised(F.col(text)).alias("norm"))
    rows = rows.select("id", digest(F.col("norm")).alias("digest"), "norm")
    # full bytes on hits: all texts of a digest are equal where the least and the greatest are
    extremes = rows.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    mixed = cut_lineage(extremes.filter(F.col("low") != F.col("high")).select("digest"))  # two texts of one digest
    sha = F.sha2("norm", 256).alias("text_sha256")
    narrow = rows.select("id", "digest", sha)
    if mixed.take(1):
        split = rows.join(mixed, "digest", "left_semi")
        by_text = split.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.withColumn("locator", F.lit(None).cast("struct<file:string,row:bigint>"))
        second = split.join(by_text, "norm").select("id", "digest", sha, "keep_id", "locator", "group_size")
        joined = narrow.join(keepers.join(mixed, "digest", "left_anti"), "digest").unionByName(second)
    else:
        joined = narrow.join(keepers, "digest")
    return joined.select(
        "id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("locator").alias("keeper"),
    )

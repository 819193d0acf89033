"""The driver's queries: each operator run on the given tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import postings
from gleaner.session import scratch, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_INDEXES: dict[tuple, str] = {}


class Tables:
    """The given tables, and the views of them the operators expect."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are work to read: one small file would keep all but one core idle."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    def docs(self) -> DataFrame:
        return self.spread("documents").select(F.col("doc_id").alias("id"), "text")

    def word_index(self) -> postings.WordIndex:
        """The stored index of the documents: written once an application, again when their files have changed."""
        files = self.documents.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
        state = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*")), F.max("file_modification_time")).first()
        key = (self.spark.sparkContext.applicationId, self.folder, *state)
        if key not in _INDEXES:
            _INDEXES[key] = scratch(self.spark, "words")
            postings.write_index(self.docs(), _INDEXES[key])
        return postings.read_index(self.spark, _INDEXES[key])

    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query"), "text")

    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")

    def centroids(self) -> DataFrame:
        """One query vector per label: the mean of its vectors."""
        spread = self.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
        mean = spread.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
        return mean.groupBy("label").agg(F.transform(ordered, lambda s: s["x"]).alias("vec")).select(
            F.col("label").cast("bigint").alias("query"), "vec"
        )

    def question_vectors(self) -> DataFrame:
        """The vector that goes with each question: the one of the same number."""
        v = self.embeddings.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"), "label")
        return v.join(self.benchmark.select(F.col("item_id").alias("query")), "query", "left_semi")

    def question_centroids(self) -> DataFrame:
        """For another route: the centroid of the label of each question's vector."""
        c = self.centroids().select(F.col("query").alias("label"), "vec")
        return self.question_vectors().select("query", F.col("label").cast("bigint").alias("label")).join(
            c, "label"
        ).select("query", "vec")


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def register(fn: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def big(*names: str):
    """Counts and ranks as BIGINT."""
    return [F.col(n).cast("bigint").alias(n) for n in names]


def six(*names: str):
    """Doubles at six places, as the SQL side has them."""
    return [F.round(F.col(n), 6).alias(n) for n in names]

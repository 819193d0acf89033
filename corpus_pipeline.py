"""A training-data pipeline over `documents`: reject toxic texts, drop repeated lines, keep one of near-duplicates,
put pseudonyms in place of personal data, pack what is left.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents, with n_chars of the new text. Other columns, whatever their names, pass through unchanged; null
texts and ids, repeated ids and empty tables are kept as they are, as far as a stage's rule does not name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import linededup, packing, pii, simhash, toxicity
from gleaner.llm.common import table
from gleaner.session import scratch, ship_package


#: A key for tests; a run of one's own names its own, as whoever has the key can undo the pseudonyms.
PII_KEY = b"a key for tests; a run of one's own names its own"


def _apart(docs: DataFrame) -> DataFrame:
    """`docs` with every column but doc_id and text under a name that no operator uses."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__column_{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` by their own names again, with the length of the text as it is now."""
    n_chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars")
    return rows.select(*[
        n_chars if c == "n_chars" else F.col(c if c in ("doc_id", "text") else f"__column_{k}").alias(c) for k, c in enumerate(docs.columns)
    ])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; learned from the labels of `sf_dir` whose documents are here. A model that
    learned nothing, for want of documents of both labels, rejects nothing."""
    ship_package(spark)
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    return _as_documents(toxicity.score(_apart(docs), model).filter(F.col("toxic_score") < 0.5), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the one of the greatest id; no document goes."""
    ship_package(spark)
    return _as_documents(linededup.line_dedup(_apart(docs)), docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays. Rows without an id cannot be told apart
    by it and stay; rows that repeat an id are one document."""
    ship_package(spark)
    groups = simhash.near_groups(docs.select("doc_id", "text"))
    kept = groups.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id")).distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(*[f"`{c}`" for c in docs.columns])


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts with pseudonyms; no document goes."""
    ship_package(spark)
    return _as_documents(pii.redact(_apart(docs), key=PII_KEY), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document left."""
    ship_package(spark)
    return packing.pack(packing.sequences(docs.select("doc_id", "text"))).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: A classifier decides what the first stage keeps, so SQL cannot give the rows; the tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Keeping a collection's stages up to date: only what is new is read, failures are kept apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import enrichment as E


@dataclass(frozen=True)
class Stage:
    """A step of enrichment: `make()` gives the function, `column` is what it reads."""

    name: str
    make: Callable[[], Callable]
    column: str
    value_type: str
    model: str = ""
    batch: int | None = None


class Store:
    """Stage tables as folders of Parquet; each run adds a folder of its own, the last row of an id counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str, schema: str, but: str | None = None) -> DataFrame:
        """All rows of a table, or those of all runs but one. Only a missing folder counts as an empty table."""
        empty = self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/run-*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty
        if but is None:
            return found
        folders = {f.rpartition("/")[0] for f in found.inputFiles()}
        others = sorted(f for f in folders if unquote(f.rpartition("/")[2]) != f"run-{but}")
        return self.spark.read.schema(schema).parquet(*map(unquote, others)) if others else empty

    def append(self, name: str, df: DataFrame, run: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/run-{run}")



def stage_schema(items: DataFrame, stage: Stage) -> str:
    key = items.schema["id"].dataType.simpleString()
    return f"id {key}, value {stage.value_type}, error string, model string"


def run_stage(items: DataFrame, stage: Stage, store: Store, run: str, retry_failed: bool = False) -> DataFrame:
    """Work on what is pending, append it, and return the stage's table.

    What this run itself wrote before is not taken as done but made again, so a repeated run ends as it did at first.
    """
    schema = stage_schema(items, stage)
    done = store.read(stage.name, schema, but=run)
    if retry_failed:
        done = E.drop_failures(done)
    todo = E.pending(items, [done], stage.model)
    worker = f"{stage.name}:{stage.model}"
    if stage.batch:
        made = E.enrich_batched(todo, stage.make, "id", stage.value_type, stage.column, stage.batch, worker)
    else:
        made = E.enrich(todo, stage.make, "id", stage.value_type, [stage.column], worker)
    store.append(stage.name, made.withColumn("model", F.lit(stage.model)), run)
    return current(store.read(stage.name, schema), items, stage.model)


def current(rows: DataFrame, items: DataFrame, model: str) -> DataFrame:
    """One row per live item made by this model; a good row counts before a failed one."""
    live = rows.filter(F.substring_index("model", "@", 1) == model.split("@", 1)[0]).join(items.select("id"), "id", "left_semi")
    best = F.max_by(F.struct("value", "error", "model"), F.col("error").isNull())
    return live.groupBy("id").agg(best.alias("r")).select("id", "r.*")


def update(items: DataFrame, stages: list[Stage], store: Store, run: str, retry_failed: bool = False) -> DataFrame:
    """Bring every stage up to date; returns (stage, rows, failed)."""
    report = None
    for stage in stages:
        table = run_stage(items, stage, store, run, retry_failed).select(F.lit(stage.name).alias("stage"), "id", "error")
        report = table if report is None else report.unionByName(table)
    return E.failure_counts(report)

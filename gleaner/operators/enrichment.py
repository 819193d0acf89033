"""Incremental enrichment: only what is new is worked on, and one bad row only loses itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.vectors import base_model
from gleaner.sources.logs import latest

BATCH = 16
_made: dict[str, Callable] = {}  # one model per Python worker


def pending(items: DataFrame, stages: Sequence[DataFrame], model: str | None = None) -> DataFrame:
    """Items with no row, good or failed, in one of the stages; with `model`, rows of another model do not count."""
    done = None
    for stage in stages:
        rows = stage
        if model is not None and "model" in stage.columns:
            rows = rows.filter(base_model(F.col("model")) == model.split("@", 1)[0])
        ids = rows.select("id").distinct()
        done = ids if done is None else done.join(ids, "id", "left_semi")
    return items.join(done, "id", "left_anti")


def _worker(key: str, make: Callable[[], Callable]) -> Callable:
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _error(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"


def enrich(
    todo: DataFrame, make: Callable[[], Callable], key: str, value_type: str, columns: Sequence[str], name: str = "fn"
) -> DataFrame:
    """(key…, value, error): `make()` gives a function of one row's `columns`, built once per worker."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = _worker(name, make)
        for pdf in batches:
            values, errors = [], []
            for row in pdf[list(columns)].itertuples(index=False, name=None):
                try:
                    values.append(fn(*row))
                    errors.append(None)
                except Exception as exc:
                    values.append(None)
                    errors.append(_error(exc))
            yield pd.DataFrame({key: pdf[key], "value": pd.Series(values, dtype="object"), "error": pd.Series(errors, dtype="object")})

    schema = f"{key} {todo.schema[key].dataType.simpleString()}, value {value_type}, error string"
    return todo.select(*dict.fromkeys([key, *columns])).mapInPandas(run, schema)


def enrich_batched(
    todo: DataFrame, make: Callable[[], Callable], key: str, value_type: str, column: str, batch: int = BATCH, name: str = "batch"
) -> DataFrame:
    """Like `enrich` for a function of a list; a batch that fails is tried again row by row."""
    def one_by_one(fn: Callable, items: list) -> Iterator[tuple]:
        for item in items:
            try:
                yield fn([item])[0], None
            except Exception as exc:
                yield None, _error(exc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = _worker(name, make)
        for pdf in batches:
            results: list[tuple] = []
            for start in range(0, len(pdf), batch):
                items = list(pdf[column].iloc[start:start + batch])
                try:
                    got = list(fn(items))
                    if len(got) != len(items):
                        raise ValueError("a batch must give one value per item")
                    results += [(v, None) for v in got]
                except Exception:
                    results += list(one_by_one(fn, items))
            yield pd.DataFrame({
                key: pdf[key], "value": pd.Series([v for v, _ in results], dtype="object"),
                "error": pd.Series([e for _, e in results], dtype="object")})

    schema = f"{key} {todo.schema[key].dataType.simpleString()}, value {value_type}, error string"
    return todo.select(*dict.fromkeys([key, column])).mapInPandas(run, schema)


def failure_counts(stages: DataFrame) -> DataFrame:
    """(stage, rows, failed)."""
    return stages.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def drop_failures(stage: DataFrame) -> DataFrame:
    """Good rows only, so the failed ones are tried again."""
    return stage.filter(F.col("error").isNull())


def merge_stage(stage: DataFrame, results: DataFrame, items: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Results replace rows of the same id; results for unknown ids are ignored.

    Of several results for one id the last by `order` counts, and among equals (or without an order) the greatest row.
    """
    known = results.join(items.select("id"), "id", "left_semi")
    others = [c for c in results.columns if c != "id"]
    known = latest(known, ["id"], [*order, *[c for c in others if c not in order]]).select(*results.columns)
    kept = stage.join(known.select("id"), "id", "left_anti")
    return kept.unionByName(known)


def reconcile(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Vectors that still compare: made by the same base model, and whole."""
    return vectors.filter((base_model(F.col("model")) == model.split("@", 1)[0]) & (F.size("vec") == dim))


def row_fingerprint(model: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", model, text), 256)


def changed_rows(texts: DataFrame, fingerprints: DataFrame, model: str) -> DataFrame:
    """Texts whose vector must be made (again): new, changed, or made by another model."""
    now = texts.withColumn("fingerprint", row_fingerprint(F.lit(model), F.col("text")))
    return now.join(fingerprints.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


def set_fingerprint(texts: DataFrame, model: str) -> DataFrame:
    """One value for the whole (id, text) set, whatever its order: combined from rows, map-side first."""
    row = F.sha2(F.concat_ws("\u0001", F.lit(model), F.col("id").cast("string"), "text"), 256)
    low = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    mixed = texts.select(low.alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("bigint").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"))
    return mixed.select("n", F.sha2(F.concat_ws(":", "n", "x", F.col("s").cast("string")), 256).alias("fingerprint"))


def newest(stage: DataFrame) -> DataFrame:
    """One row per id of an appended stage table (id, at, …)."""
    return latest(stage, ["id"], ["at"])

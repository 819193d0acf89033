"""Ranking by vector similarity: block products inside tasks, partitioned and combined by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.blocks import rank_scores
from gleaner.operators.ordering import global_rank, top_k
from gleaner.session import broadcast_if_small, spread, take_bounded

MAX_QUERIES = 20_000
SCORE_DIGITS = 9  # similarities are compared at this precision, so a rank never depends on partitioning
_CELLS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vector columns of one row, in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def base_model(model: Column) -> Column:
    """A re-quantised copy (`model@variant`) compares with the model it was made from."""
    return F.substring_index(model, "@", 1)


def usable(vectors: DataFrame, dim: int, model: str | None = None) -> DataFrame:
    """Vectors of the query's size and, where both name one, of its model."""
    ok = F.size("vec") == dim
    if model is not None and "model" in vectors.columns:
        ok = ok & (base_model(F.col("model")) == model.split("@", 1)[0])
    return vectors.filter(ok)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def query_matrix(queries: DataFrame) -> tuple[list, np.ndarray]:
    """The query side of one pass as a matrix, at most MAX_QUERIES rows."""
    rows = take_bounded(queries.select("query", "vec").orderBy("query"), MAX_QUERIES, "query vectors")
    return [r["query"] for r in rows], np.array([r["vec"] for r in rows], dtype=np.float64)


def query_blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """The queries in parts of at most about `size`; every query is in one of them."""
    n = queries.count()
    if n <= size:
        return [queries]
    parts = -(-3 * n // (2 * size))
    return [queries.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == p) for p in range(parts)]


def score_vectors(
    queries: DataFrame, vectors: DataFrame, depth: int | None = None, model: str | None = None, floor: float = np.inf
) -> DataFrame:
    """(query, id, score) of every vector against every query, without a shuffle.

    With `depth`, each task keeps only its best `depth` per query, enough for an exact global top `depth`, and
    whatever reaches `floor`. A route whose vectors do not fit the query is empty. More queries than one pass
    may hold take several.
    """
    blocks = query_blocks(queries, MAX_QUERIES)
    scored = [_score_block(block, vectors, depth, model, floor) for block in blocks]
    return reduce(DataFrame.unionByName, scored)


def _score_block(queries: DataFrame, vectors: DataFrame, depth: int | None, model: str | None, floor: float) -> DataFrame:
    names, q = query_matrix(queries)
    spark = vectors.sparkSession
    query_type = queries.schema["query"].dataType.simpleString()
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"query {query_type}, id {id_type}, score double"
    if not names:
        return spark.createDataFrame([], schema)
    names_arrow = pa.array(names)
    shared = spark.sparkContext.broadcast(q)
    cast_names = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[query_type]
    names_arrow = names_arrow.cast(cast_names)

    def send(rows: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [names_arrow.take(rows["q"].combine_chunks()), rows["id"].combine_chunks(), rows["score"].combine_chunks()],
            names=["query", "id", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mat = shared.value
        step = max(1, _CELLS // len(mat))
        best: pa.Table | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sims = np.round(matrix(part.column("vec")) @ mat.T, SCORE_DIGITS) + 0.0
                n, m = sims.shape
                if depth is None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            names_arrow.take(pa.array(np.tile(np.arange(m), n))),
                            part.column("id").take(pa.array(np.repeat(np.arange(n), m))),
                            pa.array(sims.ravel()),
                        ],
                        names=["query", "id", "score"],
                    )
                    continue
                # ties may reach past position `depth`: keep everything at or above the depth-th score
                lowest = np.partition(sims, n - depth, axis=0)[n - depth] if n > depth else np.full(m, -np.inf)
                row, col = np.nonzero((sims >= lowest) | (sims >= floor))
                found = pa.table(
                    {"q": pa.array(col), "id": part.column("id").take(pa.array(row)), "score": pa.array(sims[row, col])}
                )
                best = found if best is None else pa.concat_tables([best, found])
                if best.num_rows > 4 * depth * m:
                    best = _local_best(best, depth, floor)
                    if best.num_rows > 2 * depth * m:  # mostly rows that reach the floor: hand them on
                        yield send(best.filter(pa.compute.greater_equal(best["score"], floor)))
                        best = best.filter(pa.compute.less(best["score"], floor))
        if best is not None:
            yield send(_local_best(best, depth, floor))

    fit = usable(vectors, q.shape[1], model).select("id", "vec")
    return fit.mapInArrow(score, schema)


def _local_best(rows: pa.Table, depth: int, floor: float) -> pa.Table:
    rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = rows["q"].to_numpy()
    first = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1])
    sizes = np.diff(np.append(first, len(q)))
    place = np.arange(len(q)) - np.repeat(first, sizes)
    return rows.filter(pa.array((place < depth) | (rows["score"].to_numpy() >= floor)))


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("id")]


def rank_route(
    queries: DataFrame,
    vectors: DataFrame,
    items: DataFrame | None = None,
    depth: int | None = None,
    empty: DataFrame | None = None,
    model: str | None = None,
) -> DataFrame:
    """(query, id, score, rank), best first, ties by id.

    Without `depth` every item is ranked: those with no vector on this route follow, by id, and those listed
    in `empty` come last of the ranked ones. With `depth` only the first `depth` places are worked out.
    """
    whole = depth is None or empty is not None
    scored = score_vectors(queries, spread(vectors, "id") if whole else vectors, None if whole else depth, model)
    if depth is not None:
        order = best_first()
        if empty is not None:
            scored = _flag_empty(scored, empty)
            order = [F.asc("last"), *order]
        return top_k(scored, ["query"], order, depth).drop("last")
    if empty is not None:
        scored = _flag_empty(scored, empty)
        ranked = global_rank(scored, ["query"], [F.asc("last"), *best_first()]).drop("last")
    else:
        ranked = rank_scores(scored, ["query"])
    if items is None:
        return ranked
    return ranked.unionByName(absent_places(queries, vectors, items, model))


def _flag_empty(scored: DataFrame, empty: DataFrame) -> DataFrame:
    marks = empty.select("id").distinct().withColumn("_empty", F.lit(True))
    return scored.join(marks, "id", "left").withColumn("last", F.coalesce("_empty", F.lit(False))).drop("_empty")


def absent_places(queries: DataFrame, vectors: DataFrame, items: DataFrame, model: str | None = None) -> DataFrame:
    """(query, id, score, rank) of items with no vector on the route: after all that have one, by id.

    Their order is the same for every query, so they are numbered once and each query's list repeats it: few rows, which
    are spread before each becomes as many as there are queries. A route none of whose vectors fits the queries ranks
    nothing.
    """
    dim = queries.select(F.size("vec").alias("d")).limit(1)
    ok = F.size("vec") == F.col("d")
    if model is not None and "model" in vectors.columns:
        ok = ok & (base_model(F.col("model")) == model.split("@", 1)[0])
    fit = vectors.crossJoin(F.broadcast(dim)).filter(ok).select("id")  # one row
    n = fit.agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    answered = queries.select("query").crossJoin(F.broadcast(n))  # one row
    numbered = global_rank(items.select("id").join(fit, "id", "left_anti"), [], [F.asc("id")], "_place")
    return spread(numbered, "_place").crossJoin(broadcast_if_small(answered)).select(
        "query", "id", F.lit(None).cast("double").alias("score"), (F.col("_n") + F.col("_place")).alias("rank")
    )


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean and least cosine of two vector sets over the same ids."""
    both = a.select("id", F.col("vec").alias("va")).join(b.select("id", F.col("vec").alias("vb")), "id")
    cos = both.filter(F.size("va") == F.size("vb")).select(dot(F.col("va"), F.col("vb")).alias("cos"))
    return cos.agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("mean_cos"), F.min("cos").alias("min_cos"))


def pair_scores(pairs: DataFrame, vectors: DataFrame, left: str, right: str) -> DataFrame:
    """Dot product for each row of `pairs` (columns `left` and `right` hold ids)."""
    lv = vectors.select(F.col("id").alias(left), F.col("vec").alias("_lv"))
    rv = vectors.select(F.col("id").alias(right), F.col("vec").alias("_rv"))
    return pairs.join(lv, left).join(rv, right).withColumn(
        "score", F.round(dot(F.col("_lv"), F.col("_rv")), SCORE_DIGITS)
    ).drop("_lv", "_rv")

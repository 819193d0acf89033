"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points, nearest first. Inverted lists, one per reference point, hold
the vectors that name it; inside a list the reference points two vectors share are counted, and pairs that share
enough are verified by their cosine in double precision. A pair is looked at in the list of its least shared
reference point only, so it counts once.

The reference points are a bounded sample of the vectors, thinned so that a dense cluster gives one of them; their
number grows with the square root of the number of vectors. Every vector is indexed. Lists are cut into blocks of a
fixed number of rows and blocks meet in pairs, so a list of any length is spread over many tasks, and a task gives
out link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.pairs import forest, pairs_in_runs, run_bounds
from gleaner.session import cut_lineage

TAU = 0.95
NEAREST = 12  # reference points that describe a vector
SHARED = 2  # of them, how many a candidate pair has in common
THIN = 0.9  # reference points are less alike than this
BLOCK = 1024


def comparable(vec: str) -> Column:
    """Whether a vector can have links: not null or empty, all components finite numbers, not all zero."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce((F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of `dim` components as rows of length 1, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)  # no square overflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def reference_points(classes: DataFrame, n: int, dim: int, seed: int = 0) -> np.ndarray:
    """Up to 4 * sqrt(n) vectors of this length, chosen by hash and thinned; seeded random ones if they are few."""
    want = max(32, int(np.ceil(4 * np.sqrt(n))))
    drawn = classes.select("vec").orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(want).collect()
    kept = np.zeros((0, dim))
    for row in unit_rows(pa.array([r["vec"] for r in drawn], pa.list_(pa.float64())), dim):
        if not len(kept) or (kept @ row).max() < THIN:
            kept = np.vstack([kept, row])
    if len(kept) < 32:
        more = np.random.default_rng([seed, dim]).standard_normal((32 - len(kept), dim))
        kept = np.vstack([kept, more / np.linalg.norm(more, axis=1, keepdims=True)])
    return kept


def nearest_points(rows: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The `k` nearest reference points of each row, nearest first."""
    like = rows @ points.T
    near = np.argpartition(-like, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(like, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype(np.int32)


def shared_pairs(perm: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a < b) that have `at_least` reference points in common, counted over the inverted lists."""
    g, k = perm.shape
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    row = np.repeat(np.arange(g), k)[order]
    counts = np.zeros(g * g, np.uint8)
    for a, b in pairs_in_runs(*run_bounds(flat[order])):
        counts += np.bincount(row[a] * g + row[b], minlength=g * g).astype(np.uint8)
    found = np.nonzero(counts >= at_least)[0]
    return found // g, found % g


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reference point in both of two rows."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(same, a, np.iinfo(np.int32).max).min(axis=1)


def _links(classes: DataFrame, n: int, dim: int, tau: float, nearest: int, shared: int, block: int) -> DataFrame:
    """(node, links, root) of the classes of one vector length; a node comes once per list in which it has links."""
    spark = classes.sparkSession
    points = reference_points(classes, n, dim)
    k = min(nearest, len(points))
    given = spark.sparkContext.broadcast(points)
    kind = classes.schema["vec"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            perm = nearest_points(unit_rows(b.column("vec"), dim), given.value, k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, perm.size + 1, k, dtype=np.int32)), pa.array(perm.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), lists, b.column("vec")], names=["node", "n", "perm", "vec"])

    described = cut_lineage(classes.select("node", "n", "vec").mapInArrow(describe, f"node bigint, n bigint, perm array<int>, vec {kind}"))
    sizes = np.zeros(len(points), np.int64)
    for r in described.select(F.explode("perm").alias("p")).groupBy("p").count().collect():  # one row per reference point
        sizes[r["p"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // block))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            perm = b.column("perm").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), k)
            node = b.column("node").to_numpy()
            mix = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            times = blocks[perm]
            other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, perm = np.repeat(row, times), np.repeat(perm, times)
            mine = (mix[row] % blocks[perm].astype(np.uint64)).astype(np.int64)
            low, high = np.minimum(mine, other), np.maximum(mine, other)
            for cut in range(0, len(row), 8192):
                part = slice(cut, cut + 8192)
                rows = b.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(perm[part]), *[pa.array(x[part].astype(np.int32)) for x in (low, high, mine)], *rows.columns],
                    names=["point", "low", "high", "mine", *rows.schema.names],
                )

    dealt = described.mapInArrow(deal, f"point int, low int, high int, mine int, node bigint, n bigint, perm array<int>, vec {kind}")

    def verify(table: pa.Table) -> pa.Table:
        g = table.num_rows
        perm = table["perm"].combine_chunks().flatten().to_numpy().reshape(g, k)
        a, b = shared_pairs(perm, shared)
        if table["low"][0].as_py() != table["high"][0].as_py():
            mine = table["mine"].to_numpy()
            a, b = a[mine[a] != mine[b]], b[mine[a] != mine[b]]
        rows = unit_rows(table["vec"], dim)
        keep = np.zeros(len(a), bool)
        for cut in range(0, len(a), 1 << 16):
            part = slice(cut, cut + (1 << 16))
            keep[part] = np.einsum("ij,ij->i", rows[a[part]], rows[b[part]]) >= tau
            inside = np.nonzero(keep[part])[0] + cut
            keep[inside] = least_shared(perm[a[inside]], perm[b[inside]]) == table["point"][0].as_py()
        a, b = a[keep], b[keep]
        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        links = np.bincount(a, n[b], g) + np.bincount(b, n[a], g)
        root = forest(a, b, g)
        some = np.nonzero(links)[0]
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})

    return dealt.groupBy("point", "low", "high").applyInArrow(verify, "node bigint, links bigint, root bigint")


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", tau: float = TAU, nearest: int = NEAREST,
    shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept): how many other vectors each links with at cosine >= `tau`, and the least id
    reachable.

    Equal vectors are one class: they link with each other and are compared once. Vectors that are null, empty or
    zero or hold null or non-finite components link with nothing and are their own component; so do vectors of
    different lengths among each other. Rows without an id count as vectors but never name a component; where no id
    is reachable component_id is null. Rows that repeat an id count as vectors of their own. No rows give no rows.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vec).alias("vec"))
    ready = rows.filter(comparable("vec"))
    classes = ready.groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("node"), "least", "n", "vec"))
    lengths = classes.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect()  # a few lengths
    found = None
    for r in lengths:
        part = _links(classes.filter(F.size("vec") == r["dim"]), r["count"], r["dim"], tau, nearest, shared, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node bigint, links bigint, root bigint")
    found = cut_lineage(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "least", "n").join(roots, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    by_vec = classes.select("node", "vec").join(answer, "node").select("vec", "n_links", "component_id")
    linked = ready.join(by_vec, "vec").select("id", "n_links", "component_id")
    alone = rows.filter(~comparable("vec")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

"""Exact similarity joins over all pairs of a vector set, without a cross join and without emitting pairs.

Vectors that are equal are joined once. The rest are cut into cells around pivots; the triangle inequality on
angles says which cells can hold a partner at all. Cells are cut into blocks of a fixed number of rows, and a
task multiplies two blocks and returns only what the operator asked for, so no task grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ordering import top_k
from gleaner.operators.vectors import SCORE_DIGITS, matrix
from gleaner.session import cut_lineage

BLOCK_ROWS = 16384
STRIP_ROWS = 1024  # rows multiplied at a time inside a task
COUNT_ROWS = 64  # of these, rows whose products are counted at a time
REPLICA_ROWS = 65536  # replicas that leave a task in one batch, give or take an input batch
_SLACK = 1e-5  # angles are compared with this much room, so rounding never loses a partner
# left rows, right rows, their products, and where the left rows stand in the right ones if these are the same block
PairFn = Callable[[pa.Table, pa.Table, np.ndarray, int | None], pa.Table]


def _unit(mat: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    return mat / np.where(norms == 0, 1.0, norms)


def _angles(mat: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(mat) @ pivots.T, -1.0, 1.0))


def _cells(vectors: DataFrame, pivots: np.ndarray, key: str) -> DataFrame:
    """Nearest pivot, the angle to it, and the vector's length."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mat = matrix(b.column("vec"))
            ang = _angles(mat, shared.value)
            home = ang.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.astype(np.int32)), pa.array(ang[np.arange(len(home)), home]),
                 pa.array(np.linalg.norm(mat, axis=1))],
                names=["cell", "angle", "length"],
            )

    return vectors.select("vec").mapInArrow(assign, "cell int, angle double, length double")


def block_pairs(
    vectors: DataFrame,
    fn: PairFn,
    schema: str,
    tau: float | None = None,
    payload: tuple[str, ...] = ("gid",),
    key: str = "gid",
    block_rows: int = BLOCK_ROWS,
    max_pivots: int | None = None,
) -> DataFrame:
    """Run `fn(left, right, products, offset)` over the strips of every two blocks that may hold a pair.

    Each unordered pair of rows meets once, in one direction; inside a block (`offset` given) it meets in both.
    With `tau`, pairs whose product cannot reach it may be left out; without, every pair meets. There are as many
    pivots as blocks, but no more than the square root of the number of rows, which each row is compared with.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    want = 1 if tau is None else max(1, min(n // block_rows, math.isqrt(n) if max_pivots is None else max_pivots))
    pivots = _unit(np.array(
        [r["vec"] for r in vectors.orderBy(F.xxhash64(key), key).limit(want).collect()], dtype=np.float64
    )) if n else np.zeros((0, 0))
    if not n:
        return spark.createDataFrame([], schema)
    stats = _cells(vectors, pivots, key).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("r"), F.max("length").alias("len")
    ).collect()  # one row per pivot
    members = np.zeros(want, dtype=np.int64)
    radius = np.full(want, -np.inf)
    for row in stats:
        members[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    longest = max(row["len"] for row in stats)
    theta = np.pi
    if tau is not None and 0 < tau < longest**2:
        theta = float(np.arccos(min(1.0, tau / longest**2)))
    elif tau is not None and tau >= longest**2:
        theta = 0.0
    reach = radius + theta + _SLACK

    def visits(ang: np.ndarray, home: np.ndarray) -> np.ndarray:
        later = np.arange(want)[None, :] > home[:, None]
        return later & (ang <= reach[None, :]) & (members > 0)[None, :]

    shared = spark.sparkContext.broadcast((pivots, reach))
    visitors = np.zeros(want, dtype=np.int64)
    if want > 1:
        def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(want, dtype=np.int64)
            for b in batches:
                ang = _angles(matrix(b.column("vec")), shared.value[0])
                total += visits(ang, ang.argmin(axis=1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(want, dtype=np.int32)), pa.array(total)], names=["cell", "v"])

        for row in vectors.select("vec").mapInArrow(count_visits, "cell int, v bigint").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            visitors[row["cell"]] = row["v"]
    m_blocks = np.maximum(1, -(-members // block_rows))
    v_blocks = -(-visitors // block_rows)

    fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in payload)
    vec_type = vectors.schema["vec"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ang = _angles(matrix(b.column("vec")), shared.value[0])
            home = ang.argmin(axis=1)
            mix = b.column("_mix").to_numpy(zero_copy_only=False)

            def replicas() -> Iterator[tuple]:
                """(rows, cell, left block, right block, on the left) of every block pair the rows meet in."""
                for c in np.unique(home):
                    mine = np.nonzero(home == c)[0]
                    block = mix[mine] % m_blocks[c]
                    for other in range(m_blocks[c]):
                        up = block <= other  # left of every later block and of its own
                        yield mine[up], c, block[up], other, True
                        yield mine[~up], c, other, block[~up], False
                    for guest in range(v_blocks[c]):
                        yield mine, c, block, m_blocks[c] + guest, True
                if want > 1:
                    who, where = np.nonzero(visits(ang, home))
                    for c in np.unique(where):
                        mine = who[where == c]
                        guest = m_blocks[c] + mix[mine] % v_blocks[c]
                        for block in range(m_blocks[c]):
                            yield mine, c, block, guest, False

            def batch(held: list[tuple]) -> pa.RecordBatch:
                take = pa.array(np.concatenate([r[0] for r in held]))
                cell, lb, rb = [
                    pa.array(np.concatenate([np.broadcast_to(r[k], len(r[0])) for r in held]).astype(np.int32)) for k in (1, 2, 3)]
                left = pa.array(np.concatenate([np.full(len(r[0]), r[4]) for r in held]))
                return pa.RecordBatch.from_arrays(
                    [cell, lb, rb, left, *[b.column(c).take(take) for c in payload], b.column("vec").take(take)],
                    names=["cell", "lb", "rb", "is_left", *payload, "vec"])

            held, n_held = [], 0
            for one in replicas():
                held.append(one)
                n_held += len(one[0])
                if n_held >= REPLICA_ROWS:
                    yield batch(held)
                    held, n_held = [], 0
            if n_held:
                yield batch(held)

    mixed = vectors.select(*payload, "vec", F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(1 << 40)).alias("_mix"))
    blocks = mixed.mapInArrow(assign, f"cell int, lb int, rb int, is_left boolean, {fields}, vec {vec_type}")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the strips give is handed on strip by strip, so no task holds the results of two whole blocks."""
        table = pa.Table.from_batches(list(batches))
        side = table["is_left"]
        left = table.filter(side)
        same = table["lb"][0].as_py() == table["rb"][0].as_py()
        right = left if same else table.filter(pa.compute.invert(side))
        other = matrix(right["vec"])
        for start in range(0, left.num_rows if right.num_rows else 0, STRIP_ROWS):
            strip = left.slice(start, STRIP_ROWS)
            products = matrix(strip["vec"]) @ other.T
            np.round(products, SCORE_DIGITS, out=products)
            products += 0.0  # no negative zeros
            yield from fn(strip, right, products, start if same else None).to_batches(REPLICA_ROWS)

    return blocks.groupBy("cell", "lb", "rb").applyInArrow(multiply, schema)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Equal vectors once: (gid = their least id, vec, n)."""
    return vectors.groupBy("vec").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("n"))


def similar_groups(groups: DataFrame, tau: float, depth: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(gid, other, score ≥ tau): the best `depth` other groups of each."""
    id_type = groups.schema["gid"].dataType.simpleString()
    schema = f"gid {id_type}, other {id_type}, score double"

    def best(a: pa.Table, b: pa.Table, s: np.ndarray) -> pa.Table:
        row, col = np.nonzero(s >= tau)
        found = pa.table({"gid": a["gid"].combine_chunks().take(pa.array(row)),
                          "other": b["gid"].combine_chunks().take(pa.array(col)), "score": pa.array(s[row, col])})
        found = found.filter(pa.compute.not_equal(found["gid"], found["other"]))
        if not found.num_rows or depth >= b.num_rows:
            return found
        found = found.sort_by([("gid", "ascending"), ("score", "descending"), ("other", "ascending")])
        code = found["gid"].combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.concatenate([[0], np.nonzero(np.diff(code))[0] + 1])
        place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        return found.filter(pa.array(place < depth))

    def fn(a: pa.Table, b: pa.Table, s: np.ndarray, offset: int | None) -> pa.Table:
        return best(a, b, s) if offset is not None else pa.concat_tables([best(a, b, s), best(b, a, s.T)])

    found = block_pairs(groups.select("gid", "vec"), fn, schema, tau=tau, block_rows=block_rows)
    return top_k(found, ["gid"], [F.desc("score"), F.asc("other")], depth).drop("rank")


def _copies(groups: DataFrame, tau: float) -> DataFrame:
    """(gid, other = gid, score ≥ tau) of the groups with more than one member."""
    own = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return groups.filter(F.col("n") > 1).select(
        "gid", F.col("gid").alias("other"), F.round(own, SCORE_DIGITS).alias("score")).filter(F.col("score") >= tau)


def similar_pairs(vectors: DataFrame, tau: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, score ≥ tau): every ordered pair of ids, copies of one vector included.

    Equal vectors are multiplied once; their ids are put in afterwards, so there are as many rows as pairs.
    """
    groups = cut_lineage(distinct_vectors(vectors))
    members = cut_lineage(vectors.join(groups.select("vec", "gid"), "vec").select("id", "gid"))
    near = similar_groups(groups, tau, (1 << 31) - 1, block_rows).unionByName(_copies(groups, tau))
    others = members.select(F.col("gid").alias("other"), F.col("id").alias("_other"))
    both = near.join(members, "gid").join(others, "other").filter(F.col("id") != F.col("_other"))
    return both.select("id", F.col("_other").alias("other"), "score")


def route_similar(vectors: DataFrame, tau: float, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, similar, score ≥ tau): the best `k` others of every id on one route, ties by id.

    Of equal vectors only the k+1 least ids can be among anyone's best k, so a group of copies of any size
    costs one row in the join and k+1 rows in the answer lists.
    """
    groups = cut_lineage(distinct_vectors(vectors))
    by_id = Window.partitionBy("vec").orderBy("id")
    firsts = vectors.select("vec", "id", F.row_number().over(by_id).alias("_rn")).filter(F.col("_rn") <= k + 1)
    firsts = firsts.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("gid"))
    firsts = firsts.select(F.col("gid").alias("other"), "ids")
    near = similar_groups(groups, tau, k + 1, block_rows)
    listed = near.unionByName(_copies(groups, tau)).join(firsts, "other").select("gid", "score", F.explode("ids").alias("similar"))
    listed = top_k(listed, ["gid"], [F.desc("score"), F.asc("similar")], k + 1)
    lists = listed.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("rank", "similar", "score"))).alias("best"))
    # one row per distinct vector goes to each of its copies; adaptive execution splits a group of many copies
    owners = vectors.select("id", "vec").join(groups.select("vec", "gid"), "vec").select("id", "gid")
    others = F.slice(F.filter("best", lambda b: b["similar"] != F.col("id")), 1, k)
    return owners.join(lists, "gid").select("id", F.inline(others)).select("id", "similar", "score")


def similar(
    text: DataFrame | None, image: DataFrame | None, k: int = 12, tau_text: float = 0.72, tau_image: float = 0.93,
    hidden: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, similar, score, rank): text similarity, or image similarity put on the text scale, the better one.

    An item's best k over both routes are among its best k on one of them.
    """
    found = None
    for vectors, tau, shift in ((text, tau_text, 0.0), (image, tau_image, tau_image - tau_text)):
        if vectors is None:
            continue
        if hidden is not None:
            vectors = vectors.join(hidden.select("id"), "id", "left_anti")
        near = route_similar(vectors.select("id", "vec"), tau, k, block_rows)
        near = near.withColumn("score", F.round(F.col("score") - shift, SCORE_DIGITS))
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("id", "similar").agg(F.max("score").alias("score"))
    return top_k(best, ["id"], [F.desc("score"), F.asc("similar")], k)


def pair_histogram(items: DataFrame, thresholds: list[float], side: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How all unordered pairs of `items` (id, vec, grp) spread over the thresholds: (bin, same, pairs).

    `bin` is how many thresholds the pair's similarity reaches. With `side`, only pairs on one side count, and
    the side is a column of the result. Pairs are counted where they are multiplied; only counts leave a task.
    Pairs that cannot reach the least threshold need not meet: how many reach none follows from the group sizes.
    Items without a side are not counted, and one without a group is like no other.
    """
    by = [side] if side else []
    if side:
        items = items.filter(F.col(side).isNotNull())
    edges = np.asarray(thresholds)
    cols = ("id", "grp") + ((side,) if side else ())
    side_type = items.schema[side].dataType.simpleString() if side else ""
    schema = (f"{side} {side_type}, " if side else "") + "bin int, same boolean, pairs bigint"

    def fn(a: pa.Table, b: pa.Table, s: np.ndarray, offset: int | None) -> pa.Table:
        codes = pa.chunked_array([*a["grp"].chunks, *b["grp"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        mine, theirs = codes[: a.num_rows], codes[a.num_rows:]
        sides = [None]
        if side:
            sa, sb = a[side].to_numpy(), b[side].to_numpy()
            sides = sorted(set(sa) & set(sb))
        total = {(which, label): np.zeros(len(edges) + 1, dtype=np.int64) for which in sides for label in (True, False)}
        for start in range(0, a.num_rows, COUNT_ROWS):  # bins and masks are as wide as the products
            part = slice(start, start + COUNT_ROWS)
            bins = np.searchsorted(edges, s[part], side="right")
            keep = np.ones(bins.shape, dtype=bool)
            if offset is not None:
                keep = np.triu(keep, offset + start + 1)
            same = mine[part][:, None] == theirs[None, :]
            for which in sides:
                mask = keep if which is None else keep & (sa[part] == which)[:, None] & (sb == which)[None, :]
                for label in (True, False):
                    total[which, label] += np.bincount(bins[mask & (same == label)], minlength=len(edges) + 1)
        out = {c: [] for c in ([side] if side else []) + ["bin", "same", "pairs"]}
        for (which, label), counts in total.items():
            for b_ in np.nonzero(counts)[0]:
                if side:
                    out[side].append(which)
                out["bin"].append(int(b_)), out["same"].append(label), out["pairs"].append(int(counts[b_]))
        types = {"bin": pa.int32(), "same": pa.bool_(), "pairs": pa.int64()}
        if side:
            types[side] = a.schema.field(side).type
        return pa.table({c: pa.array(v, type=types[c]) for c, v in out.items()})

    tau = min(thresholds, default=0.0)
    counted = block_pairs(
        items.select(*cols, "vec"), fn, schema, tau=tau if tau > 0 else None, payload=cols, key="id", block_rows=block_rows)
    reached = cut_lineage(counted.filter("bin > 0").groupBy(*by, "bin", "same").agg(F.sum("pairs").alias("pairs")))
    sizes = items.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n"))
    alike = F.coalesce(F.sum(F.when(F.col("grp").isNotNull(), F.expr("n * (n - 1) div 2"))), F.lit(0))
    every = sizes.groupBy(*by).agg(alike.alias("alike"), F.sum("n").alias("n")).select(*by, F.explode(F.array(
        F.struct(F.lit(True).alias("same"), F.col("alike").alias("pairs")),
        F.struct(F.lit(False).alias("same"), F.expr("n * (n - 1) div 2 - alike").alias("pairs")))).alias("all"))
    left = every.select(*by, "all.same", "all.pairs").unionByName(reached.select(*by, "same", (-F.col("pairs")).alias("pairs")))
    none = left.groupBy(*by, "same").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")
    return reached.unionByName(none.select(*by, F.lit(0).alias("bin"), "same", "pairs"))

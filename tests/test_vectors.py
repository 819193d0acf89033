"""Vector ranking and similarity against plain matrices."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import similarity as S
from gleaner.operators import vectors as V
from tests.oracle import check


def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _frame(spark, mat, name="id", parts=4):
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(mat)]
    return spark.createDataFrame(rows, f"{name} bigint, vec array<double>").repartition(parts)


def _scores(a, b):
    return np.round(a @ b.T, V.SCORE_DIGITS) + 0.0


@pytest.fixture(scope="module")
def clustered():
    """Five clusters, a third of the vectors equal, some scores tied."""
    rng = np.random.default_rng(3)
    centres = _unit(rng.normal(size=(5, 8)))
    mat = _unit(centres[rng.integers(0, 5, 260)] + 0.15 * rng.normal(size=(260, 8)))
    mat[rng.permutation(260)[:90]] = mat[0]
    return np.round(mat, 2)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_depth_gives_the_first_places_of_the_full_ranking(spark, clustered, parts):
    queries, items = _frame(spark, clustered[:6], "query"), _frame(spark, clustered, parts=parts)
    full = {(r.query, r.rank): r.id for r in V.rank_route(queries, items).collect()}
    top = {(r.query, r.rank): r.id for r in V.rank_route(queries, items, depth=40).collect()}
    assert len(full) == 6 * 260 and len(top) == 6 * 40
    assert all(full[k] == v for k, v in top.items())
    for q in range(6):
        s = _scores(clustered[q:q + 1], clustered)[0]
        want = sorted(range(260), key=lambda i: (-s[i], i))
        assert [full[q, k + 1] for k in range(260)] == want


def test_items_without_a_vector_follow_and_empty_ones_come_last(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    vec = spark.createDataFrame([("b", [1.0, 0.0])], "id string, vec array<double>")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query int, vec array<double>")
    ranked = {r.rank: r.id for r in V.rank_route(query, vec, items).collect()}
    assert ranked == {1: "b", 2: "a", 3: "c"}
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.0])], "id string, vec array<double>")
    empty = spark.createDataFrame([("a",)], "id string")
    assert {r.rank: r.id for r in V.rank_route(query, two, empty=empty).collect()} == {1: "b", 2: "a"}


def test_vectors_of_another_size_or_model_are_skipped(spark):
    query = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query int, vec array<double>")
    two = spark.createDataFrame([("a", [1.0, 0.0], "m")], "id string, vec array<double>, model string")
    assert V.rank_route(query, two).count() == 0
    three = spark.createDataFrame([("a", [1.0, 0.0, 0.0], "m@8bit"), ("b", [1.0, 0.0, 0.0], "n")], "id string, vec array<double>, model string")
    assert [r.id for r in V.rank_route(query, three, model="m@fp32").collect()] == ["a"]


@pytest.mark.parametrize("block,pivots", [(4096, 128), (16, 128), (67, 3)])
def test_similar_equals_brute_force(spark, clustered, block, pivots, monkeypatch):
    k, tau = 7, 0.8
    real = S.block_pairs
    monkeypatch.setattr(S, "STRIP_ROWS", 29)
    monkeypatch.setattr(S, "block_pairs", lambda *a, **kw: real(*a, **{**kw, "max_pivots": pivots}))
    got = {}
    for r in S.similar(_frame(spark, clustered), None, k=k, tau_text=tau, block_rows=block).collect():
        got.setdefault(r.id, []).append((r.rank, r.similar))
    s = _scores(clustered, clustered)
    for i in range(len(clustered)):
        near = sorted((j for j in range(len(clustered)) if j != i and s[i, j] >= tau), key=lambda j: (-s[i, j], j))[:k]
        assert [x for _, x in sorted(got.get(i, []))] == near


def test_similar_takes_the_better_route_and_drops_hidden(spark, clustered):
    other = clustered[:, ::-1] * np.where(np.arange(len(clustered)) % 2, 1.0, 0.6)[:, None]
    hidden = spark.createDataFrame([(0,), (5,)], "id bigint")
    got = {}
    found = S.similar(_frame(spark, clustered), _frame(spark, other), k=5, tau_text=0.7, tau_image=0.9, hidden=hidden)
    for r in found.collect():
        got.setdefault(r.id, {})[r.rank] = (r.similar, round(r.score, 6))
    a, b = _scores(clustered, clustered), _scores(other, other)
    for i in set(range(len(clustered))) - {0, 5}:
        best = {}
        for j in set(range(len(clustered))) - {0, 5, i}:
            marks = [a[i, j]] * int(a[i, j] >= 0.7) + [round(b[i, j] - (0.9 - 0.7), 9)] * int(b[i, j] >= 0.9)
            if marks:
                best[j] = max(marks)
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got.get(i, {}).get(n + 1) for n in range(len(want))] == [(j, round(s, 6)) for j, s in want]
        assert len(got.get(i, {})) == len(want)


@pytest.mark.parametrize("block", [4096, 50])
def test_pairs_are_counted_once(spark, clustered, block, monkeypatch):
    monkeypatch.setattr(S, "STRIP_ROWS", 23)
    grp = np.arange(len(clustered)) % 7
    items = _frame(spark, clustered).withColumn("grp", F.col("id") % 7).withColumn("side", (F.col("grp") % 2).cast("int"))
    edges = [0.2, 0.5, 0.9]
    got = {(r.bin, r.same): r.pairs for r in S.pair_histogram(items, edges, block_rows=block).collect()}
    s = _scores(clustered, clustered)
    want, sided = {}, {}
    for i in range(len(grp)):
        for j in range(i + 1, len(grp)):
            key = (int(np.searchsorted(edges, s[i, j], side="right")), bool(grp[i] == grp[j]))
            want[key] = want.get(key, 0) + 1
            if grp[i] % 2 == grp[j] % 2:
                sided[(grp[i] % 2, *key)] = sided.get((grp[i] % 2, *key), 0) + 1
    assert got == want
    got = {(r.side, r.bin, r.same): r.pairs for r in S.pair_histogram(items, edges, side="side", block_rows=block).collect()}
    assert got == sided


@pytest.mark.parametrize("block", [4096, 50])
def test_all_pairs_hold_copies(spark, clustered, block):
    got = {(r.id, r.other): r.score for r in S.similar_pairs(_frame(spark, clustered), 0.8, block_rows=block).collect()}
    s = _scores(clustered, clustered)
    assert got == {(i, j): s[i, j] for i in range(len(s)) for j in range(len(s)) if i != j and s[i, j] >= 0.8}


def test_vector_join_equals_its_sql_on_copies(spark, clustered, tmp_path):
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(clustered)]
    rows += [(1000 + k, [0.1] * 8, 0) for k in range(3)]  # copies too short to reach the similarity
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert check(spark, con, "o28_vector_join", str(tmp_path)) is None


@pytest.mark.parametrize("side", [None, "side"])
def test_counting_takes_no_more_memory_than_the_products(spark, monkeypatch, side):
    held = {}
    plain = S.block_pairs

    def seen(vectors, fn, schema, **named):
        held["fn"] = fn
        return plain(vectors, fn, schema, **named)

    monkeypatch.setattr(S, "block_pairs", seen)
    S.pair_histogram(spark.createDataFrame([(1, [1.0], "a", 0), (2, [1.0], "a", 0)], "id bigint, vec array<double>, grp string, side int"), [0.3, 0.6], side)
    a, b = (pa.table({"grp": ["x", "y"] * (n // 2), "side": pa.array([0, 1] * (n // 2), pa.int32())}) for n in (512, 4096))
    products = np.random.default_rng(1).random((512, 4096))
    tracemalloc.start()
    counted = held["fn"](a, b, products, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(counted["pairs"].to_pylist()) == products.size // (2 if side else 1)
    assert peak < products.nbytes

"""Fused search without ranking everything.

A fused score is a sum of 1/(k + rank). An item outside the first D places of every one of R routes scores at
most R/(k + 1 + D), while the n-th best item scores at least 1/(k + n), because any single route has n items at
rank n or better. So for D = R(k + n) − k the best n are among the routes' first D places. For these few items the
exact rank on each route is found by counting, in one pass over the vectors, how many are ahead of them: nothing
is sorted but the candidates, and only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import fusion, postings
from gleaner.operators.ordering import global_rank, top_k
from gleaner.operators.vectors import SCORE_DIGITS, best_first, dot, matrix, query_blocks, query_matrix, score_vectors, usable
from gleaner.session import cut_lineage

MAX_CANDIDATES = 500_000  # candidates of one pass; they are handed to every task
QUERIES_PER_PASS = 1000
Routes = dict[str, tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Words:
    """A stored index, the queries' wording in it, and the documents with enough of it to take part in the ranking."""

    index: postings.WordIndex
    wording: postings.Wording
    lex: DataFrame


def _numpy_ids(ids: list) -> np.ndarray:
    return np.array(ids) if ids else np.array([], dtype=np.int64)


def count_ahead(queries: DataFrame, vectors: DataFrame, scored: pd.DataFrame) -> np.ndarray:
    """How many vectors are before each row of `scored` (query, id, score) on its query's ranking."""
    names, mat = query_matrix(queries)
    rows = scored.reset_index(drop=True).sort_values(["query", "score", "id"], ascending=[True, False, True])
    lists = []
    for name in names:
        mine = rows[rows["query"] == name]
        lists.append((mine.index.to_numpy(), -mine["score"].to_numpy(), _numpy_ids(mine["id"].tolist())))
    shared = vectors.sparkSession.sparkContext.broadcast((mat, [(neg, ids) for _, neg, ids in lists]))
    width = max((len(neg) for _, neg, _ in lists), default=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, cands = shared.value
        total = np.zeros((len(cands), width + 1), dtype=np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = _numpy_ids(b.column("id").to_pylist())
            sims = np.round(matrix(b.column("vec")) @ q.T, SCORE_DIGITS) + 0.0
            for n, (neg, cids) in enumerate(cands):
                if len(neg) == 0:
                    continue
                left = np.searchsorted(neg, -sims[:, n], side="left")
                right = np.searchsorted(neg, -sims[:, n], side="right")
                for r in np.nonzero(left < right)[0]:  # a tie with candidates: the smaller id is ahead
                    left[r] += np.searchsorted(cids[left[r]:right[r]], ids[r], side="right")
                total[n] += np.bincount(left, minlength=width + 1)
        n, slot = np.nonzero(total[:, :width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(n.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[n, slot])], names=["q", "slot", "n"])

    fit = usable(vectors, mat.shape[1]).select("id", "vec") if len(names) else vectors.limit(0).select("id", "vec")
    counted = fit.mapInArrow(count, "q int, slot int, n bigint").groupBy("q", "slot").agg(F.sum("n").alias("n")).toPandas()
    grid = np.zeros((len(names), width + 1), dtype=np.int64)
    grid[counted["q"].to_numpy(), counted["slot"].to_numpy()] = counted["n"].to_numpy()
    grid = grid.cumsum(axis=1)
    ahead = np.zeros(len(rows), dtype=np.int64)
    for n, (index, neg, _) in enumerate(lists):
        ahead[index] = grid[n, : len(neg)]
    return ahead


def places_of(ids_table: DataFrame, wanted: list) -> dict:
    """The 1-based place of each wanted id among all ids of the table, in order of id, by counting."""
    ids = _numpy_ids(sorted(wanted))
    if not len(ids):
        return {}
    shared = ids_table.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                slots = np.searchsorted(shared.value, _numpy_ids(b.column("id").to_pylist()), side="left")
                total += np.bincount(slots, minlength=len(total))
        slot = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    counted = ids_table.select("id").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    grid = np.zeros(len(ids), dtype=np.int64)
    grid[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return dict(zip(ids.tolist(), grid.cumsum().tolist()))


def candidate_hits(
    queries: DataFrame, docs: DataFrame, routes: Routes, depth: int, words: Words, text_routes: tuple[str, ...],
    lex_floor: float, match_floor: float, lex_match: float,
) -> DataFrame | None:
    """(query, id, score, match, lex), exact, of items in the first `depth` places of a route or sure to match.

    None when they are too many to be handed to every task.
    """
    spark = docs.sparkSession
    items = docs.select("id")
    lex = words.lex
    lex_ranked = cut_lineage(
        global_rank(lex.filter(F.col("share") >= lex_floor).withColumnRenamed("share", "score"), ["query"], best_first()))
    picked = [lex_ranked.filter(F.col("rank") <= depth).select("query", "id"), lex.filter(F.col("share") >= lex_match).select("query", "id")]
    live, without, sizes, vectors_of = {}, {}, {}, {}
    for route, (qv, iv) in routes.items():
        qv = cut_lineage(qv.join(queries.select("query"), "query", "left_semi").select("query", "vec"))
        vectors_of[route] = qv
        live[route] = iv.join(items, "id", "left_semi").select("id", "vec")  # read three times, never sorted
        without[route] = items.join(iv.select("id"), "id", "left_anti")
        sizes[route] = live[route].count()
        floor = match_floor if route in text_routes else np.inf
        near = cut_lineage(score_vectors(qv, live[route], depth, floor=floor))
        picked.append(top_k(near, ["query"], best_first(), depth).select("query", "id"))
        picked.append(near.filter(F.col("score") >= floor).select("query", "id"))
        if sizes[route] < depth:  # the first places go on with items that have no vector, by id
            few = without[route].orderBy("id").limit(depth - sizes[route])
            picked.append(qv.select("query").crossJoin(F.broadcast(few)))  # at most queries × depth
    candidates = cut_lineage(reduce(DataFrame.unionByName, picked).distinct())
    if candidates.count() > MAX_CANDIDATES:
        return None
    ranks = [lex_ranked.join(candidates, ["query", "id"], "left_semi").select("query", "id", "rank")]
    evidence = []
    for route in routes:
        qv = vectors_of[route]
        asked = candidates.join(qv.select("query", F.col("vec").alias("_q")), "query")
        scored = asked.join(live[route], "id", "left").select(
            "query", "id", F.round(dot(F.col("_q"), F.col("vec")), SCORE_DIGITS).alias("score"))
        table = scored.toPandas()  # at most MAX_CANDIDATES rows
        known = table["score"].notna().to_numpy()
        rank = np.zeros(len(table), dtype=np.int64)
        if known.any():
            rank[known] = count_ahead(qv, live[route], table[known]) + 1
        if (~known).any():
            place = places_of(without[route], table.loc[~known, "id"].unique().tolist())
            rank[~known] = sizes[route] + table.loc[~known, "id"].map(place).to_numpy()
        table["rank"] = rank
        schema = f"query {queries.schema['query'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double, rank bigint"
        table["score"] = table["score"].astype(object).where(known, None)
        ranked = spark.createDataFrame(table, schema)
        ranks.append(ranked.select("query", "id", "rank"))
        if route in text_routes:
            evidence.append(ranked.select("query", "id", F.col("score").alias("match")))
    fused = fusion.fuse_scores(reduce(DataFrame.unionByName, ranks))
    best = reduce(DataFrame.unionByName, evidence).groupBy("query", "id").agg(F.max("match").alias("match"))
    said = postings.shares_of(candidates, words.wording, words.index).withColumnRenamed("share", "lex")
    joined = fused.join(best, ["query", "id"], "left").join(said, ["query", "id"], "left")
    return joined.select("query", "id", "score", "match", F.coalesce("lex", F.lit(0.0)).alias("lex"))


def _full_hits(queries: DataFrame, docs: DataFrame, routes: Routes, text_routes, lex_floor, script_map) -> DataFrame:
    some = {r: (qv.join(queries.select("query"), "query", "left_semi"), iv) for r, (qv, iv) in routes.items()}
    return fusion.hits(fusion.route_rankings(queries, docs, some, text_routes, lex_floor, script_map))


def _words(queries: DataFrame, index: postings.WordIndex, floor: float) -> Words:
    wording = postings.asked(queries, index)
    return Words(index, wording, cut_lineage(postings.shares_at_least(queries, index, floor, wording)))


def halves(queries: DataFrame) -> list[DataFrame]:
    """The queries in two or three parts, for a pass with fewer candidates; none if there is but one query."""
    n = queries.count()
    parts = query_blocks(queries, -(-n // 2)) if n > 1 else []
    return [p for p in map(cut_lineage, parts) if not p.isEmpty()]


def search_top(
    queries: DataFrame, docs: DataFrame, routes: Routes, k: int = 10, text_routes: tuple[str, ...] = ("ocr",),
    lex_floor: float = fusion.LEX_FLOOR, script_map: dict[str, str] | None = None,
    index: postings.WordIndex | None = None,
) -> DataFrame:
    """The same rows as `fusion.search`: the best `k` of each query.

    Queries with too many candidates together are asked in smaller passes; only one query that has too many by itself
    is ranked in full.
    """
    index = index or postings.temporary_index(docs, script_map)
    n_routes = len(routes) + 1
    depth = n_routes * (fusion.RRF_K + k) - fusion.RRF_K
    found, waiting = [], query_blocks(queries, QUERIES_PER_PASS)
    while waiting:
        block = waiting.pop()
        words = _words(block, index, lex_floor)
        hits = candidate_hits(block, docs, routes, depth, words, text_routes, lex_floor, np.inf, np.inf)
        if hits is None:
            fewer = halves(block)
            if len(fewer) > 1:
                waiting += fewer
                continue
            hits = _full_hits(block, docs, routes, text_routes, lex_floor, script_map)
        found.append(top_k(hits, ["query"], best_first(), k))
    return reduce(DataFrame.unionByName, found)


def split_top(
    queries: DataFrame, docs: DataFrame, routes: Routes, maybe_k: int = 12, hidden: DataFrame | None = None,
    text_routes: tuple[str, ...] = ("ocr",), lex_floor: float = fusion.LEX_FLOOR,
    match_threshold: float = fusion.MATCH_THRESHOLD, lex_match: float = fusion.LEX_MATCH, script_map: dict[str, str] | None = None,
    index: postings.WordIndex | None = None,
) -> DataFrame:
    """The same rows as `fusion.split_search`: all confident matches, and the best `maybe_k` others.

    A query is settled once its last candidate scores above what any item not looked at could score; for the
    others the routes are followed further down. Queries with too many candidates together are asked in smaller
    passes.
    """
    index = index or postings.temporary_index(docs, script_map)
    n_routes = len(routes) + 1
    n_items = docs.count()
    first = n_routes * (fusion.RRF_K + 4 * maybe_k) - fusion.RRF_K
    found, waiting = [], [(block, first) for block in query_blocks(queries, QUERIES_PER_PASS)]
    while waiting:
        block, depth = waiting.pop()
        words = _words(block, index, min(lex_floor, lex_match))
        while True:
            hits = None
            if depth < n_items:
                hits = candidate_hits(block, docs, routes, depth, words, text_routes, lex_floor, match_threshold, lex_match)
            if hits is None:
                fewer = halves(block) if depth < n_items else []
                if len(fewer) > 1:
                    waiting += [(part, depth) for part in fewer]
                    break
                found.append(fusion.split_search(
                    _full_hits(block, docs, routes, text_routes, lex_floor, script_map), maybe_k, hidden, match_threshold, lex_match))
                break
            split = cut_lineage(fusion.split_search(hits, maybe_k, hidden, match_threshold, lex_match))
            bound = n_routes / (fusion.RRF_K + 1 + depth)
            sure = split.filter((F.col("section") == "maybe") & (F.col("rank") == maybe_k) & (F.col("score") > bound)).select("query")
            open_ = cut_lineage(block.join(sure, "query", "left_anti"))
            if open_.isEmpty():
                found.append(split)
                break
            found.append(split.join(sure, "query", "left_semi"))
            block, depth = open_, depth * 4
            words = replace(words, lex=words.lex.join(block.select("query"), "query", "left_semi"))
    return reduce(DataFrame.unionByName, found)

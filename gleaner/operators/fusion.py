"""Several rankings of the same items into one, and the split into confident matches and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.blocks import rank_scores, rank_sums
from gleaner.operators.lexical import lexical_score
from gleaner.operators.ordering import global_rank, top_k
from gleaner.operators.vectors import absent_places, best_first, rank_route, score_vectors
from gleaner.session import cut_lineage, spread

# Calibrated defaults, to be replaced for other models.
RRF_K = 60
MATCH_THRESHOLD = 0.57
LEX_MATCH = 0.8
LEX_FLOOR = 0.5

FUSED_DIGITS = 12


def fuse_scores(rankings: DataFrame, k: int = RRF_K, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """Sum of 1/(k+rank) over the routes that rank an item."""
    summed = rankings.filter(F.col("rank").isNotNull()).groupBy(*keys, "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return summed.withColumn("score", F.round("score", FUSED_DIGITS))


def rrf_fuse(
    rankings: DataFrame, k: int = RRF_K, depth: int | None = None, keys: tuple[str, ...] = ("query",)
) -> DataFrame:
    """Fused order (-score, id); `depth` keeps the first places only."""
    if depth is None:
        return rank_sums(rankings, keys, k, FUSED_DIGITS)
    return top_k(fuse_scores(rankings, k, keys), list(keys), best_first(), depth)


def route_rankings(
    queries: DataFrame,
    docs: DataFrame,
    routes: dict[str, tuple[DataFrame, DataFrame]],
    text_routes: tuple[str, ...] = ("ocr",),
    lex_floor: float = LEX_FLOOR,
    script_map: dict[str, str] | None = None,
) -> DataFrame:
    """(query, route, id, rank, match, lex): all routes ranked in one ordered pass, with what decides a match.

    `routes` maps a route to (query vectors, item vectors); every id of `docs` is an item. A row without a rank
    only says how much of the query's wording an item has.
    """
    items = docs.select("id")
    lex = cut_lineage(lexical_score(queries, docs, script_map).withColumn("share", F.round("share", FUSED_DIGITS)))
    scores = [lex.filter(F.col("share") >= lex_floor).select("query", "id", F.col("share").alias("score"), F.lit("lex").alias("route"))]
    absent = []
    for route, (qv, iv) in routes.items():
        qv = cut_lineage(qv.select("query", "vec"))
        live = iv.join(items, "id", "left_semi")
        scores.append(score_vectors(qv, spread(live, "id")).withColumn("route", F.lit(route)))
        absent.append(absent_places(qv, live, items).withColumn("route", F.lit(route)))
    ranked = rank_scores(reduce(DataFrame.unionByName, scores), ["query", "route"])
    ranked = reduce(DataFrame.unionByName, absent, ranked)
    match = F.when(F.col("route").isin(*text_routes), F.col("score"))
    none = F.lit(None).cast("double")
    said = lex.select("query", F.lit("lex").alias("route"), "id", F.lit(None).cast("bigint").alias("rank"), none.alias("match"), F.col("share").alias("lex"))
    return ranked.select("query", "route", "id", "rank", match.alias("match"), none.alias("lex")).unionByName(said)


def hits(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Every ranked item of a query with its fused score and its evidence, in one aggregation."""
    found = rankings.groupBy("query", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), FUSED_DIGITS).alias("score"), F.max("match").alias("match"),
        F.coalesce(F.max("lex"), F.lit(0.0)).alias("lex"))
    return found.filter(F.col("score").isNotNull())


def search(rankings: DataFrame, k: int = 10) -> DataFrame:
    return top_k(hits(rankings), ["query"], best_first(), k)


def mark_matches(found: DataFrame, match_threshold: float = MATCH_THRESHOLD, lex_match: float = LEX_MATCH) -> DataFrame:
    sure = (F.coalesce("match", F.lit(-1.0)) >= match_threshold) | (F.col("lex") >= lex_match)
    return found.withColumn("is_match", sure)


def split_search(
    found: DataFrame,
    maybe_k: int = 12,
    hidden: DataFrame | None = None,
    match_threshold: float = MATCH_THRESHOLD,
    lex_match: float = LEX_MATCH,
) -> DataFrame:
    """Confident matches in fused order, then the best `maybe_k` others.

    Hidden items keep the ranks they took and are dropped here, so the others are filled up to `maybe_k`.
    """
    marked = mark_matches(found, match_threshold, lex_match)
    if hidden is not None:
        marked = marked.join(hidden.select("id"), "id", "left_anti")
    matches = global_rank(marked.filter("is_match"), ["query"], best_first()).withColumn("section", F.lit("matches"))
    maybe = top_k(marked.filter("not is_match"), ["query"], best_first(), maybe_k).withColumn("section", F.lit("maybe"))
    return matches.unionByName(maybe).drop("is_match")


def rank_all(
    text: tuple[DataFrame, DataFrame],
    image: tuple[DataFrame, DataFrame],
    description: tuple[DataFrame, DataFrame],
    textless: DataFrame,
) -> DataFrame:
    """Five rankings per query for an ablation: three routes, and two fusions of them."""
    single = {
        "ocr": rank_route(*text, empty=textless),
        "clip": rank_route(*image),
        "vlm": rank_route(*description),
    }
    named = {m: r.select("query", "id", "rank", F.lit(m).alias("method")) for m, r in single.items()}
    fused = []
    for method, parts in (("hybrid_no_vlm", ("ocr", "clip")), ("hybrid", ("ocr", "clip", "vlm"))):
        ranked = rrf_fuse(reduce(DataFrame.unionByName, [named[p] for p in parts]))
        fused.append(ranked.select("query", "id", "rank", F.lit(method).alias("method")))
    return reduce(DataFrame.unionByName, [*named.values(), *fused])

"""Retrieval queries: wording, vectors, fusion, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import exact, fusion, lexical, postings, similarity, vectors
from gleaner.plans import sql
from gleaner.plans.registry import Tables, big, query, six
from gleaner.session import broadcast_if_small


@query("o32_lexical_units", f"""
SELECT id, len(us)::BIGINT AS n_units, md5(array_to_string(us, ' ')) AS units
FROM (SELECT doc_id AS id, {sql.UNITS.format('text')} AS us FROM documents)""")
def lexical_units(t: Tables) -> DataFrame:
    us = t.docs().select("id", T.units(F.col("text")).alias("us"))
    return us.select("id", F.size("us").cast("bigint").alias("n_units"), F.md5(F.array_join("us", " ")).alias("units"))


@query("o33_build_lexical_index", f"""
WITH {sql.LEXICAL} SELECT gram, df::BIGINT AS df, round(idf, 6) AS idf, round(unseen, 6) AS unseen FROM grams""")
def build_lexical_index(t: Tables) -> DataFrame:
    """The weights by the stored index, which this query writes if it is not there yet."""
    index = t.word_index()
    return lexical.weigh(index.counts, index.size).select("gram", "df", *six("idf", "unseen"))


@query("o34_lexical_score", f"""
WITH {sql.LEXICAL} SELECT query, id, round(share, 6) AS share FROM lexical""")
def lexical_score(t: Tables) -> DataFrame:
    return postings.all_shares(t.questions(), t.word_index()).select("query", "id", *six("share"))


@query("o27_probe_postings", f"""
WITH {sql.LEXICAL} SELECT query, id, count(*)::BIGINT AS shared FROM wanted JOIN doc_grams USING (gram) GROUP BY query, id""")
def probe_postings(t: Tables) -> DataFrame:
    """The inverted-index probe alone: how many of a query's grams each document holds."""
    wanted = lexical.query_grams(t.questions())
    return broadcast_if_small(wanted).join(t.word_index().inverted, "gram").groupBy("query", "id").agg(F.count(F.lit(1)).alias("shared"))


TOP_LEXICAL = f"""
WITH {sql.LEXICAL} SELECT query, id, round(share, 6) AS share, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY share DESC, id) AS rank FROM lexical) WHERE rank <= 10"""


@query("o69_top_k", TOP_LEXICAL)
def lexical_top(t: Tables) -> DataFrame:
    """The ten documents that say most of each question."""
    return postings.top_shares(t.questions(), t.word_index(), 10).select("query", "id", *six("share"), "rank")


@query("o35_rank_route", f"""
WITH {sql.VECTORS},
scores AS (SELECT c.label AS query, e.vec_id AS id, round({sql.dot('e.embedding', 'c.vec')}, 9) AS score
           FROM centroids c, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
placed AS (SELECT c.label AS query, d.doc_id AS id, s.score FROM centroids c CROSS JOIN documents d
           LEFT JOIN scores s ON s.query = c.label AND s.id = d.doc_id)
SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, id) AS rank
FROM placed""")
def rank_route(t: Tables) -> DataFrame:
    """Every document ranked for every label's centroid; documents without a vector follow."""
    live = t.vectors().join(t.docs(), "id", "left_semi")
    return vectors.rank_route(t.centroids(), live, t.docs()).select("query", "id", *six("score"), "rank")


@query("o35_rank_route_depth", f"""
WITH {sql.VECTORS},
scores AS (SELECT c.label AS query, e.vec_id AS id, round({sql.dot('e.embedding', 'c.vec')}, 9) AS score
           FROM centroids c, embeddings e)
SELECT query, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 50""")
def rank_route_depth(t: Tables) -> DataFrame:
    """The best fifty vectors per centroid: local best per task, then one small merge."""
    return vectors.rank_route(t.centroids(), t.vectors(), depth=50).select("query", "id", *six("score"), "rank")


def _routes(t: Tables) -> dict:
    return {"ocr": (t.question_vectors(), t.vectors()), "clip": (t.question_centroids(), t.vectors())}


def _asked(t: Tables) -> DataFrame:
    return t.questions()


@query("o31_rrf_fuse", f"""
WITH {sql.SEARCH}
SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fused""")
def rrf_fuse(t: Tables) -> DataFrame:
    rankings = fusion.route_rankings(_asked(t), t.docs(), _routes(t))
    return fusion.rrf_fuse(rankings).select("query", "id", *six("score"), "rank")


@query("o37_search", f"""
WITH {sql.SEARCH}
SELECT query, id, round(score, 6) AS score, round(match, 6) AS match, round(lex, 6) AS lex, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM hits) WHERE rank <= 10""")
def search(t: Tables) -> DataFrame:
    """The ten best of each question; only the routes' first places are looked at, with the same result."""
    return exact.search_top(_asked(t), t.docs(), _routes(t), 10, index=t.word_index()).select("query", "id", *six("score", "match", "lex"), "rank")


@query("o38_split_search", f"""
WITH {sql.SEARCH},
marked AS (SELECT *, coalesce(match, -1) >= 0.57 OR lex >= 0.8 AS sure FROM hits),
sectioned AS (SELECT *, row_number() OVER (PARTITION BY query, sure ORDER BY score DESC, id) AS rank FROM marked)
SELECT query, id, round(score, 6) AS score, round(match, 6) AS match, round(lex, 6) AS lex, rank,
       CASE WHEN sure THEN 'matches' ELSE 'maybe' END AS section
FROM sectioned WHERE sure OR rank <= 12""")
def split_search(t: Tables) -> DataFrame:
    found = exact.split_top(_asked(t), t.docs(), _routes(t), index=t.word_index())
    return found.select("query", "id", *six("score", "match", "lex"), "rank", "section")


@query("o39_search_visible", f"""
WITH {sql.SEARCH},
marked AS (SELECT *, coalesce(match, -1) >= 0.57 OR lex >= 0.8 AS sure FROM hits
           WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)),
sectioned AS (SELECT *, row_number() OVER (PARTITION BY query, sure ORDER BY score DESC, id) AS rank FROM marked)
SELECT query, id, round(score, 6) AS score, rank, CASE WHEN sure THEN 'matches' ELSE 'maybe' END AS section
FROM sectioned WHERE sure OR rank <= 12""")
def search_visible(t: Tables) -> DataFrame:
    """Rejected and removed documents keep the ranks they took, then drop out."""
    hidden = t.labels.filter("quality = 0 OR toxic = 1").select(F.col("doc_id").alias("id"))
    found = exact.split_top(_asked(t), t.docs(), _routes(t), hidden=hidden, index=t.word_index())
    return found.select("query", "id", *six("score"), "rank", "section")


@query("o25_live_vectors", """
SELECT vec_id AS id, len(embedding)::BIGINT AS dim FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""")
def live_vectors(t: Tables) -> DataFrame:
    """Index rows restricted to the items there are now."""
    live = t.vectors().join(t.docs(), "id", "left_semi")
    return live.select("id", F.size("vec").cast("bigint").alias("dim"))


_HALF = "list_slice(embedding, 1, 32)"


def _halves(t: Tables) -> DataFrame:
    return t.vectors().select("id", F.slice("vec", 1, 32).alias("vec"), "label")


@query("o36_similar", f"""
WITH text_pairs AS (
  SELECT a.vec_id AS id, b.vec_id AS other, round({sql.dot('a.embedding', 'b.embedding')}, 9) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
image_pairs AS (
  SELECT a.id, b.id AS other, round({sql.dot('a.h', 'b.h')}, 9) AS score
  FROM (SELECT vec_id AS id, {_HALF} AS h FROM embeddings) a JOIN (SELECT vec_id AS id, {_HALF} AS h FROM embeddings) b
  ON a.id <> b.id),
either AS (SELECT * FROM text_pairs WHERE score >= 0.35
         UNION ALL SELECT id, other, round(score - (0.4::DOUBLE - 0.35::DOUBLE), 9) FROM image_pairs WHERE score >= 0.4),
best AS (SELECT id, other, max(score) AS score FROM either GROUP BY id, other)
SELECT id, other, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM best) WHERE rank <= 12""")
def similar(t: Tables) -> DataFrame:
    """For every vector the twelve nearest on either of two routes (whole vectors, and their first half)."""
    found = similarity.similar(t.vectors(), _halves(t), k=12, tau_text=0.35, tau_image=0.4)
    return found.select("id", F.col("similar").alias("other"), *six("score"), "rank")


@query("o28_vector_join", f"""
WITH pairs AS (
  SELECT a.vec_id AS id, b.vec_id AS other, round({sql.dot('a.embedding', 'b.embedding')}, 9) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT id, other, round(score, 6) AS score FROM pairs WHERE score >= 0.35""")
def vector_join(t: Tables) -> DataFrame:
    """The join alone: all pairs of vectors at or above a similarity, copies with each other too."""
    return similarity.similar_pairs(t.vectors().select("id", "vec"), 0.35).select("id", "other", *six("score"))


@query("o41_rank_all", f"""
WITH {sql.VECTORS},
half_centroids AS (SELECT label, list_slice(vec, 1, 32) AS h FROM centroids),
textless AS (SELECT d.doc_id AS id FROM documents d WHERE length(d.text) < 200),
scores AS (
  SELECT 'ocr' AS method, q.query, e.vec_id AS id, round({sql.dot('e.embedding', 'q.vec')}, 9) AS score FROM qv q, embeddings e
  UNION ALL SELECT 'clip', q.query, e.vec_id, round({sql.dot('e.embedding', 'q.vec')}, 9) FROM qc q, embeddings e
  UNION ALL SELECT 'vlm', q.query, e.vec_id, round({sql.dot('list_slice(e.embedding, 1, 32)', 'list_slice(q.vec, 1, 32)')}, 9)
            FROM qv q, embeddings e),
single AS (SELECT method, query, id, row_number() OVER (PARTITION BY method, query ORDER BY
             method = 'ocr' AND id IN (SELECT id FROM textless), score DESC, id) AS rank FROM scores),
fused AS (
  SELECT 'hybrid_no_vlm' AS method, query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM single
  WHERE method <> 'vlm' GROUP BY query, id
  UNION ALL SELECT 'hybrid', query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) FROM single GROUP BY query, id)
SELECT method, query, id, rank FROM single
UNION ALL SELECT method, query, id, row_number() OVER (PARTITION BY method, query ORDER BY score DESC, id) FROM fused""")
def rank_all(t: Tables) -> DataFrame:
    """Five rankings per question; documents under 200 characters count as having no text."""
    textless = t.docs().filter(F.length("text") < 200).select("id")
    halved = t.question_vectors().select("query", F.slice("vec", 1, 32).alias("vec"))
    return fusion.rank_all(
        (t.question_vectors(), t.vectors()), (t.question_centroids(), t.vectors()), (halved, _halves(t)), textless
    ).select("method", "query", "id", "rank")


@query("o53_compare_runs", f"""
WITH run_a AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
run_b AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: round(x, 1)) AS vec FROM embeddings)
SELECT count(*)::BIGINT AS n, round(avg(cos), 6) AS mean_cos, round(min(cos), 6) AS min_cos
FROM (SELECT list_dot_product(a.vec, b.vec) AS cos FROM run_a a JOIN run_b b USING (id))""")
def compare_vectors(t: Tables) -> DataFrame:
    """Vectors against a coarse copy of themselves (one decimal)."""
    coarse = t.vectors().select("id", F.transform("vec", lambda x: F.round(x.cast("double"), 1)).alias("vec"))
    return vectors.compare_vectors(t.vectors(), coarse).select("n", *six("mean_cos", "min_cos"))

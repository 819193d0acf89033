"""Evaluation queries: retrieval metrics, thresholds, pair statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import fusion, metrics, vectors
from gleaner.operators.ordering import global_rank
from gleaner.operators.similarity import pair_histogram
from gleaner.plans import sql
from gleaner.plans.registry import Tables, big, query, six
from gleaner.plans.retrieval import _halves, _routes
from gleaner.session import cut_lineage

# Label classes of the vectors, as queries: an item is relevant for its own label's centroid.
RANKED = f"""{sql.VECTORS},
scores AS (
  SELECT 'whole' AS method, c.label AS query, e.vec_id AS id, round({sql.dot('e.embedding', 'c.vec')}, 9) AS score
  FROM centroids c, embeddings e
  UNION ALL SELECT 'half', c.label, e.vec_id, round({sql.dot('list_slice(e.embedding, 1, 32)', 'list_slice(c.vec, 1, 32)')}, 9)
  FROM centroids c, embeddings e),
rankings AS (SELECT *, row_number() OVER (PARTITION BY method, query ORDER BY score DESC, id) AS rank FROM scores),
qrels AS (SELECT e.label::BIGINT AS query, e.vec_id AS relevant FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.toxic = 1),
firsts AS (SELECT m.method, q.query, min(r.rank) AS first
           FROM (SELECT DISTINCT method FROM rankings) m CROSS JOIN (SELECT DISTINCT query FROM qrels) q
           LEFT JOIN (SELECT r.* FROM rankings r JOIN qrels q ON r.query = q.query AND r.id = q.relevant) r
             ON r.method = m.method AND r.query = q.query
           GROUP BY m.method, q.query)
"""


def _rankings(t: Tables) -> DataFrame:
    halved = t.centroids().select("query", F.slice("vec", 1, 32).alias("vec"))
    whole = vectors.rank_route(t.centroids(), t.vectors()).withColumn("method", F.lit("whole"))
    half = vectors.rank_route(halved, _halves(t)).withColumn("method", F.lit("half"))
    return whole.unionByName(half)


def _qrels(t: Tables) -> DataFrame:
    """Known answers per label: its vectors that a labeller flagged."""
    flagged = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    marked = t.vectors().join(flagged, "id", "left_semi")
    return marked.select(F.col("label").cast("bigint").alias("query"), F.col("id").alias("relevant"))


@query("o43_recall_at_k", f"""
WITH {RANKED} SELECT count(*)::BIGINT AS n, round(count(*) FILTER (first <= 5) / count(*), 6) AS recall FROM firsts
WHERE method = 'whole'""")
def recall(t: Tables) -> DataFrame:
    return metrics.recall_at_k(_rankings(t).filter("method = 'whole'"), _qrels(t), 5).select("n", *six("recall"))


@query("o44_mrr", f"""
WITH {RANKED} SELECT count(*)::BIGINT AS n, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM firsts
WHERE method = 'whole'""")
def mrr(t: Tables) -> DataFrame:
    return metrics.mrr(_rankings(t).filter("method = 'whole'"), _qrels(t)).select("n", *six("mrr"))


@query("o45_score_methods", f"""
WITH {RANKED} SELECT method, count(*)::BIGINT AS n, round(count(*) FILTER (first <= 1) / count(*), 6) AS recall_1,
  round(count(*) FILTER (first <= 5) / count(*), 6) AS recall_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr
FROM firsts GROUP BY method""")
def score_methods(t: Tables) -> DataFrame:
    return metrics.score_methods(_rankings(t), _qrels(t)).select("method", "n", *six("recall_1", "recall_5", "mrr"))


# Questions whose passage occurs in a document are labeled with those documents.
QUOTED = "qrels AS (SELECT b.item_id AS query, d.doc_id AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _quoted(t: Tables) -> DataFrame:
    """Documents holding a question's text verbatim: found by its bytes first, so no text meets every question.

    Written once: the metrics read it several times."""
    from gleaner.operators.lexical import verbatim

    return cut_lineage(verbatim(t.questions(), t.docs()).select("query", F.col("id").alias("relevant")))


@query("o46_match_quality", f"""
WITH {sql.SEARCH}, {QUOTED},
sure AS (SELECT query, id FROM hits WHERE coalesce(match, -1) >= 0.57 OR lex >= 0.8),
per_query AS (
  SELECT l.query, coalesce(bool_or(r.relevant IS NOT NULL), false) AS found,
         count(s.id) FILTER (r.relevant IS NULL) AS filler
  FROM (SELECT DISTINCT query FROM qrels) l LEFT JOIN sure s USING (query)
  LEFT JOIN qrels r ON r.query = s.query AND r.relevant = s.id GROUP BY l.query)
SELECT count(*)::BIGINT AS n, round(avg(found::INT), 6) AS match_recall, round(avg(filler), 6) AS filler_per_query FROM per_query""")
def match_quality(t: Tables) -> DataFrame:
    rankings = fusion.route_rankings(t.questions(), t.docs(), _routes(t))
    sure = fusion.mark_matches(fusion.hits(rankings)).filter("is_match")
    return metrics.match_quality(sure, _quoted(t)).select("n", *six("match_recall", "filler_per_query"))


@query("o47_auc", """
WITH scored AS (SELECT n_chars::DOUBLE AS score, quality = 1 AS label FROM labels JOIN documents USING (doc_id)),
ranked AS (SELECT label, avg(rn) OVER (PARTITION BY score) AS r FROM (
  SELECT *, row_number() OVER (ORDER BY score) AS rn FROM scored))
SELECT count(*) FILTER (label)::BIGINT AS n_pos, count(*) FILTER (NOT label)::BIGINT AS n_neg,
  round((sum(r) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2)
        / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auc FROM ranked""")
def auc(t: Tables) -> DataFrame:
    """How well a document's length tells good from bad."""
    scored = t.labels.join(t.documents, "doc_id").select(
        F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("label")
    )
    return metrics.auc(scored).select("n_pos", "n_neg", *six("auc"))


@query("o48_balanced_accuracy", """
WITH p AS (SELECT quality = 1 AS label, n_chars >= 500 AS guess FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (label AND guess) AS tp, count(*) FILTER (label AND NOT guess) AS fn,
             count(*) FILTER (NOT label AND NOT guess) AS tn, count(*) FILTER (NOT label AND guess) AS fp FROM p)
SELECT tp::BIGINT AS tp, fn::BIGINT AS fn, tn::BIGINT AS tn, fp::BIGINT AS fp,
       round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS bal_acc FROM c""")
def balanced_accuracy(t: Tables) -> DataFrame:
    joined = t.labels.join(t.documents, "doc_id")
    got = metrics.balanced_accuracy(joined, F.col("quality") == 1, F.col("n_chars") >= 500)
    return got.select("tp", "fn", "tn", "fp", *six("bal_acc"))


_STEPS = [s / 100 for s in range(5, 55)]
PAIRS = f"""
items AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label AS grp,
                 (dense_rank() OVER (ORDER BY label) - 1) % 2 AS side FROM embeddings),
pairs AS (SELECT a.grp = b.grp AS same, a.side AS sa, b.side AS sb, round(list_dot_product(a.vec, b.vec), 9) AS sim
          FROM items a JOIN items b ON a.id < b.id),
steps AS (SELECT s / 100.0::DOUBLE AS threshold FROM range(5, 55) r(s))
"""


def _grouped(t: Tables) -> DataFrame:
    return t.vectors().select("id", "vec", F.col("label").alias("grp"))


@query("o30_pair_labels", f"""
WITH {PAIRS} SELECT same, count(*)::BIGINT AS pairs, count(*) FILTER (sim >= 0.3)::BIGINT AS close FROM pairs GROUP BY same""")
def pair_labels(t: Tables) -> DataFrame:
    """All unordered pairs by whether they share a group, counted where they are multiplied."""
    counted = pair_histogram(_grouped(t), [0.3])
    close = F.sum(F.when(F.col("bin") == 1, F.col("pairs")).otherwise(0))
    return counted.groupBy("same").agg(F.sum("pairs").alias("pairs"), close.alias("close"))


@query("o49_best_threshold", f"""
WITH {PAIRS},
swept AS (SELECT threshold, (avg((sim >= threshold)::INT) FILTER (same) + avg((sim < threshold)::INT) FILTER (NOT same)) / 2 AS bal_acc
          FROM pairs CROSS JOIN steps GROUP BY threshold)
SELECT threshold, round(bal_acc, 6) AS bal_acc FROM swept ORDER BY round(bal_acc, 12) DESC, threshold LIMIT 1""")
def best_threshold(t: Tables) -> DataFrame:
    swept = metrics.pair_sweep(_grouped(t), _STEPS).withColumn("bal_acc", F.round("bal_acc", 12))
    return metrics.best_threshold(swept).select("threshold", *six("bal_acc"))


@query("o50_heldout_accuracy", f"""
WITH {PAIRS},
swept AS (SELECT sa AS side, threshold,
            round((avg((sim >= threshold)::INT) FILTER (same) + avg((sim < threshold)::INT) FILTER (NOT same)) / 2, 12) AS bal_acc
          FROM pairs CROSS JOIN steps WHERE sa = sb GROUP BY sa, threshold),
best AS (SELECT side, threshold FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY bal_acc DESC, threshold) AS r FROM swept) WHERE r = 1)
SELECT round(avg(s.bal_acc), 6) AS bal_acc FROM swept s JOIN best b ON s.side = 1 - b.side AND s.threshold = b.threshold""")
def heldout(t: Tables) -> DataFrame:
    return metrics.heldout_accuracy(_grouped(t), _STEPS).select(*six("bal_acc"))


@query("o42_quote_overlap", f"""
WITH {sql.LEXICAL},
n AS (SELECT l.query, l.id, {sql.norm('b.text')} AS q, {sql.norm('d.text')} AS t
      FROM lexical l JOIN benchmark b ON b.item_id = l.query JOIN documents d ON d.doc_id = l.id WHERE l.share >= 0.3)
SELECT query, id, round(len(list_filter(range(1, length(q)), lambda i: contains(t, substring(q, i, 2)))) / (length(q) - 1), 6) AS overlap FROM n""")
def quote_overlap(t: Tables) -> DataFrame:
    """Character overlap of each question with the documents that share enough of its wording."""
    from gleaner.operators.lexical import lexical_score

    near = lexical_score(t.questions(), t.docs()).filter(F.round("share", fusion.FUSED_DIGITS) >= 0.3).select("query", "id")
    q = t.questions().select("query", T.norm(F.col("text")).alias("_q"))
    d = t.docs().select("id", T.norm(F.col("text")).alias("_t"))
    both = near.join(q, "query").join(d, "id")
    return both.select("query", "id", F.round(T.quote_overlap(F.col("_q"), F.col("_t")), 6).alias("overlap"))


METHODS = f"""{sql.SEARCH}, {QUOTED},
final AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fused),
by_method AS (SELECT route AS method, query, id, rank FROM ranked UNION ALL SELECT 'hybrid', query, id, rank FROM final),
firsts AS (SELECT m.method, q.query, min(r.rank) AS first
           FROM (SELECT DISTINCT method FROM by_method) m CROSS JOIN (SELECT DISTINCT query FROM qrels) q
           LEFT JOIN (SELECT r.* FROM by_method r JOIN qrels q ON r.query = q.query AND r.id = q.relevant) r
             ON r.method = m.method AND r.query = q.query GROUP BY m.method, q.query)
"""


def _methods(t: Tables) -> DataFrame:
    rankings = fusion.route_rankings(t.questions(), t.docs(), _routes(t))
    single = rankings.filter("rank IS NOT NULL").select(F.col("route").alias("method"), "query", "id", "rank")
    return single.unionByName(fusion.rrf_fuse(rankings).select(F.lit("hybrid").alias("method"), "query", "id", "rank"))


@query("o51_score_by_quote", f"""
WITH {METHODS},
shares AS (
  SELECT query, max(len(list_filter(range(1, length(q)), lambda i: contains(t, substring(q, i, 2)))) / (length(q) - 1)) AS overlap
  FROM (SELECT r.query, {sql.norm('b.text')} AS q, {sql.norm('d.text')} AS t FROM qrels r
        JOIN benchmark b ON b.item_id = r.query JOIN documents d ON d.doc_id = r.relevant) GROUP BY query)
SELECT CASE WHEN overlap >= 0.5 THEN 'quote_like' ELSE 'descriptive' END AS subset, method, count(*)::BIGINT AS n,
  round(count(*) FILTER (first <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (first <= 5) / count(*), 6) AS recall_5,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr
FROM firsts JOIN shares USING (query) GROUP BY subset, method""")
def score_by_quote(t: Tables) -> DataFrame:
    qrels = _quoted(t)
    overlaps = metrics.query_overlap(qrels, t.questions(), t.docs())
    return metrics.score_by_quote(_methods(t), qrels, overlaps).select(
        "subset", "method", "n", *six("recall_1", "recall_5", "mrr"))


@query("o51_decisions", f"""
WITH {METHODS},
scores AS (SELECT method, count(*) FILTER (first <= 5) / count(*) AS recall_5 FROM firsts GROUP BY method),
row AS (SELECT max(recall_5) FILTER (method = 'ocr') AS ocr, max(recall_5) FILTER (method = 'clip') AS clip,
               max(recall_5) FILTER (method = 'hybrid') AS hybrid FROM scores)
SELECT hybrid >= 0.7 AS hybrid_passes, round((clip - ocr) * 100, 1) AS gain_points, round((clip - ocr) * 100, 1) >= 15.0 AS keep_route FROM row""")
def decisions(t: Tables) -> DataFrame:
    """The decision row, the centroid route standing in for descriptions."""
    renamed = _methods(t).withColumn("method", F.when(F.col("method") == "clip", "vlm").otherwise(F.col("method")))
    return metrics.decisions(metrics.score_methods(renamed, _quoted(t)))


@query("o53_compare_results", f"""
WITH {RANKED},
tops AS (SELECT method, query, list(id ORDER BY rank) AS top FROM rankings WHERE rank <= 10 GROUP BY method, query)
SELECT count(*)::BIGINT AS n, round(avg(len(list_intersect(a.top, b.top)) / 10), 6) AS top10_overlap,
       count(*) FILTER (a.top[1] = b.top[1])::BIGINT AS same_top1,
       count(*) FILTER (list_sort(a.top) = list_sort(b.top))::BIGINT AS same_set
FROM tops a JOIN tops b ON a.query = b.query WHERE a.method = 'whole' AND b.method = 'half'""")
def compare_results(t: Tables) -> DataFrame:
    """Two runs over the same queries: how much of the first ten they share."""
    from gleaner.operators.comparison import compare_results as compare

    halved = t.centroids().select("query", F.slice("vec", 1, 32).alias("vec"))
    return compare(vectors.rank_route(t.centroids(), t.vectors(), depth=10), vectors.rank_route(halved, _halves(t), depth=10)).select(
        "n", *six("top10_overlap"), "same_top1", "same_set")


@query("o89_pair_similarity", f"""
WITH n AS (SELECT count(*) // 2 AS n FROM embeddings),
a AS (SELECT vec_id // 2 AS tpl, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id // 2 AS tpl, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 2 = 1),
scored AS (
  SELECT round(list_dot_product(a.vec, b.vec), 9) AS score, true AS label FROM a JOIN b USING (tpl)
  UNION ALL SELECT round(list_dot_product(a.vec, b.vec), 9), false FROM a CROSS JOIN n JOIN b ON b.tpl = (a.tpl + 1) % n.n),
ranked AS (SELECT label, avg(rn) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM scored))
SELECT count(*) FILTER (label)::BIGINT AS n_pos, count(*) FILTER (NOT label)::BIGINT AS n_neg,
  round((sum(r) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2)
        / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auc FROM ranked""")
def pair_similarity(t: Tables) -> DataFrame:
    """Vectors in twos as templates: both of one template against one of it and one of the next."""
    by_two = t.vectors().groupBy(F.floor(F.col("id") / 2).alias("tpl")).agg(
        F.min("id").alias("left"), F.max("id").alias("right"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    n = by_two.agg(F.count(F.lit(1)).alias("total"))
    aligned = by_two.select("left", "right", F.lit(True).alias("label"))
    after = by_two.crossJoin(F.broadcast(n)).select("left", ((F.col("tpl") + 1) % F.col("total")).alias("tpl"))  # one row
    shifted = after.join(by_two.select("tpl", "right"), "tpl").select("left", "right", F.lit(False).alias("label"))
    scored = vectors.pair_scores(aligned.unionByName(shifted), t.vectors(), "left", "right")
    return metrics.auc(scored).select("n_pos", "n_neg", *six("auc"))


@query("o87_normalize_pattern", f"""
WITH items AS (SELECT doc_id AS id, source AS grp, array_to_string(list_transform(
    regexp_split_to_array(line, '[\\{{\\[【［]\\s*[XYZxyz]\\s*[\\}}\\]】］]'),
    lambda p: {sql.norm('p')}), '{{S}}') AS key FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)),
g AS (SELECT count(*) AS n FROM items GROUP BY grp), k AS (SELECT count(*) AS n FROM items GROUP BY key),
gk AS (SELECT count(*) AS n FROM items GROUP BY grp, key), a AS (SELECT count(*) AS n FROM items),
c AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM gk) AS tp, (SELECT sum(n * (n - 1) // 2) FROM g) AS same,
             (SELECT sum(n * (n - 1) // 2) FROM k) AS equal, (SELECT sum(n * (n - 1) // 2) FROM a) AS total)
SELECT tp::BIGINT AS tp, (same - tp)::BIGINT AS fn, (total - same - equal + tp)::BIGINT AS tn, (equal - tp)::BIGINT AS fp,
       round((tp / same + (total - same - equal + tp) / (total - same)) / 2, 6) AS bal_acc FROM c""")
def same_pattern(t: Tables) -> DataFrame:
    """Do lines of one source follow the same pattern? All lines, equal as a pattern key."""
    lines = t.documents.select(F.col("source").alias("grp"), F.explode(F.split("text", "\n")).alias("text"))
    return metrics.same_pattern(lines).select("tp", "fn", "tn", "fp", *six("bal_acc"))

"""Common parts of the SQL twins (DuckDB)."""

UNITS = "regexp_extract_all(lower({0}), '[a-z0-9]+|[\\p{{L}}\\p{{Nl}}\\p{{No}}]')"


def norm(col: str) -> str:
    return f"lower(regexp_replace({col}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


LEXICAL = f"""
doc_units AS (SELECT doc_id AS id, {UNITS.format('text')} AS us FROM documents WHERE length(text) > 0),
doc_grams AS (
  SELECT id, unnest(list_distinct(list_concat(us,
    list_transform(range(1, greatest(len(us), 1)), lambda i: us[i] || ' ' || us[i + 1])))) AS gram FROM doc_units),
corpus AS (SELECT count(*) AS n FROM documents WHERE length(text) > 0),
grams AS (SELECT gram, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 0.5)) AS idf,
                 ln((any_value(n) + 1) / 0.5) AS unseen FROM doc_grams, corpus GROUP BY gram),
query_units AS (SELECT item_id AS query, {UNITS.format('text')} AS us FROM benchmark),
wanted AS (
  SELECT query, unnest(CASE WHEN len(us) = 1 THEN us ELSE list_distinct(
    list_transform(range(1, greatest(len(us), 1)), lambda i: us[i] || ' ' || us[i + 1])) END) AS gram FROM query_units),
totals AS (SELECT query, sum(coalesce(idf, ln((n + 1) / 0.5))) AS total
           FROM wanted LEFT JOIN grams USING (gram), corpus GROUP BY query),
lexical AS (
  SELECT query, id, round(sum(idf) / any_value(total), 12) AS share
  FROM wanted JOIN grams USING (gram) JOIN doc_grams USING (gram) JOIN totals USING (query) GROUP BY query, id)
"""

VECTORS = f"""
centroids AS (
  SELECT label::BIGINT AS label, list(x ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label),
qv AS (SELECT vec_id AS query, embedding::DOUBLE[] AS vec, label FROM embeddings
       WHERE vec_id IN (SELECT item_id FROM benchmark)),
qc AS (SELECT query, c.vec FROM qv JOIN centroids c ON c.label = qv.label),
ocr_scores AS (SELECT q.query, e.vec_id AS id, round({dot('e.embedding', 'q.vec')}, 9) AS score
               FROM qv q, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
clip_scores AS (SELECT q.query, e.vec_id AS id, round({dot('e.embedding', 'q.vec')}, 9) AS score
                FROM qc q, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents))
"""

SEARCH = f"""{LEXICAL}, {VECTORS},
answered AS (SELECT DISTINCT query FROM qv),
placed AS (
  SELECT query, 'lex' AS route, id, share AS score FROM lexical WHERE share >= 0.5
  UNION ALL SELECT a.query, 'ocr', d.doc_id, s.score FROM answered a CROSS JOIN documents d
            LEFT JOIN ocr_scores s ON s.query = a.query AND s.id = d.doc_id
  UNION ALL SELECT a.query, 'clip', d.doc_id, s.score FROM answered a CROSS JOIN documents d
            LEFT JOIN clip_scores s ON s.query = a.query AND s.id = d.doc_id),
ranked AS (SELECT query, route, id, row_number() OVER (PARTITION BY query, route ORDER BY score DESC NULLS LAST, id) AS rank
           FROM placed),
fused AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM ranked GROUP BY query, id),
hits AS (SELECT f.query, f.id, f.score, o.score AS match, coalesce(l.share, 0.0) AS lex
         FROM fused f LEFT JOIN ocr_scores o ON o.query = f.query AND o.id = f.id
                      LEFT JOIN lexical l ON l.query = f.query AND l.id = f.id)
"""

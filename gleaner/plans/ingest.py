"""Ingest queries: duplicates, reports, signatures, labeled queries, pages, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.plans import sql
from gleaner.plans.cleaning import strip_sql
from gleaner.plans.registry import Tables, big, query
from gleaner.sources import files, logs, pages, qrels

DEDUP = """
hashed AS (SELECT doc_id, source, substring(sha256(text), 1, 16) AS id FROM documents),
firsts AS (SELECT *, first_value(doc_id) OVER w AS first, row_number() OVER w > 1 AS is_duplicate
           FROM hashed WINDOW w AS (PARTITION BY id ORDER BY source, doc_id))
"""


def _hashed(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", "source", files.content_id(F.col("text").cast("binary")).alias("id"))


@query("o02_dedup_by_content", f"WITH {DEDUP} SELECT id, doc_id, source, first, is_duplicate FROM firsts")
def dedup_by_content(t: Tables) -> DataFrame:
    return files.dedup_by_content(_hashed(t), "id", ["source", "doc_id"], "doc_id").select("id", "doc_id", "source", "first", "is_duplicate")


@query("o03_scan_report", f"""
WITH {DEDUP} SELECT count(*) FILTER (quality IS DISTINCT FROM 0 AND NOT is_duplicate)::BIGINT AS ok,
  count(*) FILTER (quality IS DISTINCT FROM 0 AND is_duplicate)::BIGINT AS duplicate, 0::BIGINT AS skipped,
  count(*) FILTER (quality = 0)::BIGINT AS unreadable FROM firsts LEFT JOIN labels USING (doc_id)""")
def scan_report(t: Tables) -> DataFrame:
    """Documents as a scan; those labelled bad count as unreadable."""
    found = files.dedup_by_content(_hashed(t), "id", ["source", "doc_id"], "doc_id").join(t.labels, "doc_id", "left")
    status = F.when(F.col("quality") == 0, "unreadable").when(F.col("is_duplicate"), "duplicate").otherwise("ok")
    return files.scan_report(found.select("source", status.alias("status")))


@query("o60_source_signature", """
SELECT source, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS bytes, max(doc_id) AS newest FROM documents GROUP BY source""")
def source_signature(t: Tables) -> DataFrame:
    return files.source_signature(t.documents.select("source", F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime")))


@query("o60_changed_sources", """
WITH b AS (SELECT d.source, count(*) AS files, sum(n_chars) AS bytes, max(doc_id) AS newest FROM documents d JOIN labels USING (doc_id)
           WHERE quality = 1 GROUP BY d.source),
a AS (SELECT source, count(*) AS files, sum(n_chars) AS bytes, max(doc_id) AS newest FROM documents WHERE lang <> 'es' GROUP BY source)
SELECT source, CASE WHEN b.files IS NULL THEN 'added' WHEN a.files IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a USING (source) WHERE b.files IS DISTINCT FROM a.files OR b.bytes IS DISTINCT FROM a.bytes OR b.newest IS DISTINCT FROM a.newest""")
def changed_sources(t: Tables) -> DataFrame:
    """The documents labelled good as yesterday's scan, all but the Spanish ones as today's."""
    slim = t.documents.select("source", F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), "lang")
    good = t.labels.filter("quality = 1").select(F.col("doc_id").alias("mtime"))
    return files.changed_sources(
        files.source_signature(slim.join(good, "mtime", "left_semi")), files.source_signature(slim.filter("lang <> 'es'")))


@query("o05_compact_log", """
SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def compact_log(t: Tables) -> DataFrame:
    """The last event of each user wins."""
    return logs.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type")


RELPATHS = "known AS (SELECT doc_id, source || '/' || lang || '-' || n_chars || '.txt' AS relpath FROM documents)"


@query("o06_resolve_qrels", f"""
WITH {RELPATHS},
named AS (SELECT 'q' || l.doc_id AS query, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN k.relpath
            ELSE regexp_replace(k.relpath, '^.*/', '') END AS name FROM labels l JOIN known k USING (doc_id)),
exact AS (SELECT relpath AS name, relpath AS exact FROM known GROUP BY relpath HAVING count(*) = 1),
base AS (SELECT regexp_replace(relpath, '^.*/', '') AS name, min(relpath) AS base FROM known GROUP BY 1 HAVING count(*) = 1)
SELECT query, name, coalesce(exact, base) AS relevant,
  CASE WHEN name IS NULL THEN 'unlabeled' WHEN coalesce(exact, base) IS NULL THEN 'unknown' ELSE 'found' END AS status
FROM named LEFT JOIN exact USING (name) LEFT JOIN base USING (name)""")
def resolve_qrels(t: Tables) -> DataFrame:
    """Labeled documents as queries: good ones name a path, bad ones only a file name, toxic ones nothing."""
    known = t.documents.select("doc_id", F.concat_ws("", "source", F.lit("/"), "lang", F.lit("-"), "n_chars", F.lit(".txt")).alias("relpath"))
    name = F.when(F.col("toxic") == 1, F.lit(" ；")).when(F.col("quality") == 1, F.replace("relpath", F.lit("/"), F.lit("\\"))).otherwise(
        F.substring_index("relpath", "/", -1))
    rows = t.labels.join(known, "doc_id").select(F.concat(F.lit("q"), F.col("doc_id")).alias("query"), name.alias("files"))
    return qrels.resolve_qrels(rows, known.select("relpath"))


@query("o12_page_assets", """
WITH links AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS root, unnest(regexp_extract_all(html, '<a\\s[^>]*>')) AS tag,
         generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*>'), 1) AS pos FROM pages),
resolved AS (
  SELECT page_id, pos, lower(regexp_replace(root, '^https?://', '')) AS site, root || array_to_string(list_transform(
    string_split(regexp_extract(tag, 'href="([^"]*)"', 1), ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]') THEN url_encode(c) ELSE c END), '') AS url
  FROM links)
SELECT page_id, site, url, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS pos FROM resolved GROUP BY page_id, site, url""")
def page_assets(t: Tables) -> DataFrame:
    """What every page links to, absolute and once (these pages hold no pictures)."""
    return pages.page_assets(t.spread("pages"), "a", "href").select("page_id", "site", "url", *big("pos"))


@query("o16_clean_meta", f"""
SELECT page_id AS id, substring(regexp_extract(url, '^https?://([^/?#:]*)', 1), 1, 40) AS site,
  nullif(substring({strip_sql("regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\s\\p{{Z}}]+', ' ', 'g')").replace('{{', '{').replace('}}', '}')}, 1, 200), '') AS page_title,
  CASE WHEN length(url) <= 2000 AND starts_with(url, 'http') THEN url END AS page_url, CAST(NULL AS VARCHAR) AS image_url FROM pages""")
def clean_meta(t: Tables) -> DataFrame:
    meta = t.pages.select(
        F.col("page_id").alias("id"), F.regexp_extract("url", "^https?://([^/?#:]*)", 1).alias("site"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"), F.col("url").alias("page_url"),
        F.concat(F.lit("javascript:"), F.col("url")).alias("image_url"), F.lit("dropped").alias("extra"))
    return pages.clean_meta(meta)


@query("o01_scan_corpus", """
WITH f AS (SELECT source, doc_id || '.' || coalesce(lang, '') AS relpath, octet_length(encode(text))::BIGINT AS size, coalesce(lang IN ('en', 'de'), false) AS wanted,
    coalesce(regexp_matches(text, '^[A-Z]'), false) AS sound, substring(sha256(text), 1, 16) AS id FROM documents),
good AS (SELECT source, relpath, size, id, first_value(source || '/' || relpath) OVER w AS first, row_number() OVER w > 1 AS again
         FROM f WHERE wanted AND sound WINDOW w AS (PARTITION BY id ORDER BY source, relpath))
SELECT id, source, relpath, size, CASE WHEN again THEN 'duplicate' ELSE 'ok' END AS status, CASE WHEN again THEN first END AS duplicate_of FROM good
UNION ALL SELECT CASE WHEN wanted THEN id END, source, relpath, size, CASE WHEN wanted THEN 'unreadable' ELSE 'skipped' END, NULL FROM f WHERE NOT (wanted AND sound)""")
def scan_corpus(t: Tables) -> DataFrame:
    """Documents as files: the source is the folder, the language the ending, a capital letter the format's first byte."""
    name = F.concat("doc_id", F.lit("."), F.coalesce("lang", F.lit("")))
    corpus = t.spread("documents").select(
        F.col("source").alias("source_pos"), "source", name.alias("relpath"), F.concat("source", F.lit("/"), name).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"), F.lit(0).alias("mtime"), F.col("text").cast("binary").alias("content"))
    found = files.classify(corpus, ("en", "de"), magic=(("CAPITAL", "^(4[1-9A-F]|5[0-9A])"),))
    return found.select("id", "source", "relpath", "size", "status", "duplicate_of")

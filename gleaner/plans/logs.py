"""Search-log queries: views are searches, clicks and purchases acts, a day is the gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import searchlog as L
from gleaner.plans.registry import Tables, big, query

DAY = 86400.0


def search_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    search = F.col("event_type") == "view"
    kind = F.when(search, "search").when(F.col("event_type").isin("click", "purchase"), "act")
    return events.select(
        F.col("user_id").alias("user"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("q"), k % 4).alias("q"), (k % 10).alias("id"),
        F.when(search, F.array(k % 10, (k + 1) % 10)).alias("matches"), F.when(search, F.array((k + 2) % 10)).alias("maybe"),
    ).filter(F.col("type").isNotNull())


LOG = """
ev AS (SELECT user_id AS usr, epoch_us(ts) / 1e6 AS t, event_id AS seq, event_type = 'view' AS search, 'q' || (k % 4) AS q, k % 10 AS id, k
       FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) WHERE event_type IN ('view', 'click', 'purchase')),
searches AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY t, seq) AS n FROM ev WHERE search),
chain AS (
  SELECT usr, n, q, t, seq, t AS start_t, seq AS start_seq FROM searches WHERE n = 1
  UNION ALL
  SELECT s.usr, s.n, s.q, s.t, s.seq,
    CASE WHEN s.q = c.q AND s.t - c.start_t < 86400 THEN c.start_t ELSE s.t END,
    CASE WHEN s.q = c.q AND s.t - c.start_t < 86400 THEN c.start_seq ELSE s.seq END
  FROM chain c JOIN searches s ON s.usr = c.usr AND s.n = c.n + 1),
acts AS (SELECT a.usr, a.t, a.seq, a.q, a.id, c.start_t, c.start_seq FROM (
    SELECT a.*, (SELECT max(n) FROM searches s WHERE s.usr = a.usr AND (s.t, s.seq) < (a.t, a.seq)) AS n FROM ev a WHERE NOT a.search) a
  LEFT JOIN chain c ON c.usr = a.usr AND c.n = a.n AND c.q = a.q),
acted AS (SELECT usr, start_t, start_seq, id, min((t, seq)) AS at1 FROM acts WHERE start_t IS NOT NULL GROUP BY usr, start_t, start_seq, id),
per AS (SELECT usr, start_t, start_seq, count(*) AS n_acted, min_by(id, at1) AS first_acted FROM acted GROUP BY usr, start_t, start_seq),
rows0 AS (SELECT s.usr, s.t AS start_t, s.seq AS start_seq, s.q, [s.k % 10, (s.k + 1) % 10] AS matches, [(s.k + 2) % 10] AS maybe,
            coalesce(p.n_acted, 0) AS n_acted, p.first_acted
          FROM searches s JOIN chain c ON c.usr = s.usr AND c.seq = s.seq AND c.start_seq = s.seq
          LEFT JOIN per p ON p.usr = s.usr AND p.start_t = s.t AND p.start_seq = s.seq),
rows1 AS (SELECT *, lead(start_t) OVER w AS next_t, lead(n_acted) OVER w AS next_acted, lead(first_acted) OVER w AS next_first
          FROM rows0 WINDOW w AS (PARTITION BY usr ORDER BY start_t, start_seq)),
rows2 AS (SELECT *, coalesce(n_acted = 0 AND next_acted > 0 AND next_t - start_t < 86400, false) AS rephrased FROM rows1)
"""


def _attached(t: Tables) -> DataFrame:
    return L.attach_sessions(search_events(t.events), DAY)


@query("o95_sessionize", f"""
WITH RECURSIVE {LOG} SELECT usr AS "user", q, round(start_t, 3) AS start_t, start_seq, n_acted::BIGINT AS n_acted, first_acted FROM rows0""")
def sessionize(t: Tables) -> DataFrame:
    rows = L.sessions(_attached(t))
    return rows.select("user", "q", F.round("start_t", 3).alias("start_t"), "start_seq", *big("n_acted"), "first_acted")


@query("o29_attach_acts", f"""
WITH RECURSIVE {LOG} SELECT usr AS "user", seq, q, id, start_seq FROM acts""")
def attach_acts(t: Tables) -> DataFrame:
    """The as-of join: each act with the session it belongs to, or none."""
    return _attached(t).filter("type = 'act'").select("user", "seq", "q", "id", "start_seq")


@query("o68_rephrased", f"""
WITH RECURSIVE {LOG} SELECT usr AS "user", start_seq, rephrased, CASE WHEN rephrased THEN next_first END AS found_next FROM rows2""")
def rephrased(t: Tables) -> DataFrame:
    rows = L.with_next(L.sessions(_attached(t)), DAY)
    return rows.select("user", "start_seq", "rephrased", F.when(F.col("rephrased"), F.col("next_first")).alias("found_next"))


@query("o96_search_summary", f"""
WITH RECURSIVE {LOG} SELECT count(*)::BIGINT AS searches, count(*) FILTER (n_acted > 0)::BIGINT AS found,
  count(*) FILTER (n_acted > 0 AND matches[1] = first_acted)::BIGINT AS found_first,
  count(*) FILTER (n_acted > 0 AND list_contains(matches, first_acted))::BIGINT AS found_in_matches,
  count(*) FILTER (n_acted > 0 AND NOT list_contains(matches, first_acted))::BIGINT AS found_in_maybe,
  count(*) FILTER (rephrased)::BIGINT AS missed_then_rephrased, count(*) FILTER (n_acted = 0)::BIGINT AS nothing_acted FROM rows2""")
def search_summary(t: Tables) -> DataFrame:
    return L.search_summary(L.with_next(L.sessions(_attached(t)), DAY))


@query("o97_export_queries", f"""
WITH RECURSIVE {LOG},
wanted AS (
  SELECT r.q, a.id, (0, r.start_t, r.start_seq, r.usr, a.at1) AS place FROM acted a JOIN rows2 r USING (usr, start_t, start_seq)
  UNION ALL SELECT q, next_first, (1, start_t, start_seq, usr, (start_t, start_seq)) FROM rows2 WHERE rephrased),
firsts AS (SELECT q, id, min(place) AS place FROM wanted GROUP BY q, id)
SELECT q AS query, string_agg('items/' || id || '.txt', ';' ORDER BY place) AS expected FROM firsts WHERE id IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY q""")
def export_queries(t: Tables) -> DataFrame:
    """Items are parts; the large ones are not in the collection any more."""
    attached = _attached(t)
    rows = L.with_next(L.sessions(attached), DAY)
    parts = t.part.filter("p_size <= 45").select(F.col("p_partkey").alias("id"))
    relpaths = parts.select("id", F.concat(F.lit("items/"), F.col("id"), F.lit(".txt")).alias("relpath"))
    return L.export_queries(L.wanted_items(attached, rows), relpaths)


@query("o20_valid_actions", """
SELECT event_id AS seq, 'q' || (k % 4) AS q, k AS id, 'open' AS action, CASE WHEN k - 10 > 0 THEN k - 10 END AS rank,
  CASE k % 3 WHEN 0 THEN 'matches' WHEN 1 THEN 'maybe' END AS section
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) WHERE event_type = 'click' AND k % 7 <> 0""")
def valid_actions(t: Tables) -> DataFrame:
    """Clicks as acts: some with a blank query, a rank out of range or an unknown section."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    acts = t.events.select(
        F.col("event_id").alias("seq"), k.alias("id"),
        F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" q"), k % 4, F.lit(" "))).alias("q"),
        F.when(F.col("event_type") == "click", "open").otherwise(F.col("event_type")).alias("action"), (k - 10).alias("rank"),
        F.when(k % 3 == 0, "matches").when(k % 3 == 1, "maybe").otherwise("elsewhere").alias("section"))
    return L.valid_actions(acts).select("seq", "q", "id", "action", "rank", "section")

"""Curation queries: documents with labels as decisions; parts as items, orders as collections, shipments as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import curation as C
from gleaner.operators import enrichment as E
from gleaner.operators.vectors import score_vectors
from gleaner.plans import sql
from gleaner.plans.registry import Tables, big, query

STATES = """
states AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 1 THEN 'kept' WHEN l.quality = 0 THEN 'rejected'
             WHEN d.lang = 'en' AND length(regexp_replace(d.text, '\\s+', '', 'g')) < 15 THEN 'pending' ELSE 'normal' END AS state
           FROM documents d LEFT JOIN labels l USING (doc_id)),
hidden AS (SELECT id FROM states WHERE state IN ('pending', 'rejected') UNION SELECT doc_id FROM labels WHERE toxic = 1)
"""


def _doc_items(t: Tables) -> DataFrame:
    return t.spread("documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("in_inbox"), "text")


def _doc_log(t: Tables) -> DataFrame:
    """Every label twice: first the opposite decision, then the one that counts."""
    right = F.when(F.col("quality") == 1, "keep").otherwise("reject")
    wrong = F.when(F.col("quality") == 1, "reject").otherwise("keep")
    row = F.explode(F.array(F.struct(wrong.alias("decision"), F.lit(0).alias("seq")), F.struct(right.alias("decision"), F.lit(1).alias("seq"))))
    return t.labels.select(F.col("doc_id").alias("id"), row.alias("r")).select("id", "r.decision", F.lit(1.0).alias("at"), "r.seq")


def _states(t: Tables) -> DataFrame:
    return C.review_state(_doc_items(t), C.latest_decisions(_doc_log(t)), t.documents.select(F.col("doc_id").alias("id")))


def _hidden_docs(t: Tables) -> DataFrame:
    return C.hidden(_states(t), t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))


@query("o18_review_state", f"WITH {STATES} SELECT id, state FROM states")
def review_state(t: Tables) -> DataFrame:
    return _states(t)


@query("o101_latest_decisions", "SELECT doc_id AS id, CASE quality WHEN 1 THEN 'keep' ELSE 'reject' END AS decision FROM labels")
def latest_decisions(t: Tables) -> DataFrame:
    return C.latest_decisions(_doc_log(t))


@query("o73_hidden", f"WITH {STATES} SELECT id FROM hidden")
def hidden(t: Tables) -> DataFrame:
    return _hidden_docs(t)


@query("o17_visible", f"WITH {STATES} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM hidden)")
def visible(t: Tables) -> DataFrame:
    return C.visible(_doc_items(t), _hidden_docs(t)).select("id")


@query("o58_review_progress", """
SELECT count(*)::BIGINT AS decided, count(*) FILTER (quality = 0)::BIGINT AS rejected, count(*) FILTER (quality = 1)::BIGINT AS kept,
  count(*) >= 200 AND count(*) FILTER (quality = 0) >= 50 AS can_train FROM labels""")
def review_progress(t: Tables) -> DataFrame:
    return C.review_progress(C.latest_decisions(_doc_log(t)))


@query("o59_library_status", f"""
WITH {STATES} SELECT count(*) FILTER (d.doc_id NOT IN (SELECT id FROM hidden))::BIGINT AS images,
  count(*) FILTER (length(d.text) > 0)::BIGINT AS with_text, count(*) FILTER (s.state = 'pending')::BIGINT AS pending_review
FROM documents d JOIN states s ON s.id = d.doc_id""")
def library_status(t: Tables) -> DataFrame:
    return C.library_status(_doc_items(t), _states(t), _hidden_docs(t))


@query("o67_review_queue", f"""
WITH {STATES} SELECT id, d.n_chars::BIGINT AS "at", row_number() OVER (ORDER BY d.n_chars DESC, id) AS pos
FROM states s JOIN documents d ON d.doc_id = s.id WHERE s.state = 'pending'""")
def review_queue(t: Tables) -> DataFrame:
    came = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("at"), F.lit(0).alias("seq"))
    return C.review_queue(_states(t), came)


# Parts: an item comes in with each shipment, and is made at its key's second.
PARTS = """
prov AS (SELECT l_partkey AS id, epoch(l_shipdate)::BIGINT AS "at", l_orderkey * 10 + l_linenumber AS seq,
           'site' || ((l_orderkey * 10 + l_linenumber) % 3) AS site, 'https://example.org/' || ((l_orderkey * 10 + l_linenumber) % 5) AS page_url
         FROM lineitem),
added AS (SELECT p_partkey AS id, coalesce(nullif(x.at1, 0), p.p_partkey, 0)::BIGINT AS added FROM part p
          LEFT JOIN (SELECT id, max_by("at", ("at", seq)) AS at1 FROM prov GROUP BY id) x ON x.id = p.p_partkey),
coll AS (SELECT l_orderkey AS cid, l_partkey AS id, min(l_linenumber)::BIGINT AS pos FROM lineitem GROUP BY l_orderkey, l_partkey),
shown AS (SELECT p_partkey AS id FROM part WHERE p_size <= 45)
"""


def _prov(t: Tables) -> DataFrame:
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_partkey").alias("id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("at"), seq.alias("seq"),
        F.concat(F.lit("site"), seq % 3).alias("site"), F.concat(F.lit("https://example.org/"), seq % 5).alias("page_url"))


def _parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("mtime"), "p_size", F.col("p_name").alias("text"))


def _added(t: Tables) -> DataFrame:
    return C.added_at(_parts(t), _prov(t))


def _coll(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("cid"), F.col("l_partkey").alias("id")).agg(
        F.min("l_linenumber").cast("bigint").alias("pos"))


def _shown(t: Tables) -> DataFrame:
    return t.part.filter("p_size <= 45").select(F.col("p_partkey").alias("id"))


@query("o63_added_at", f"WITH {PARTS} SELECT id, added FROM added")
def added_at(t: Tables) -> DataFrame:
    return _added(t).select("id", *big("added"))


@query("o62_assign_numbers", f"""
WITH {PARTS}, given AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS no FROM part WHERE p_size > 25)
SELECT id, no FROM given UNION ALL
SELECT id, (SELECT max(no) FROM given) + row_number() OVER (ORDER BY added, id) FROM added WHERE id NOT IN (SELECT id FROM given)""")
def assign_numbers(t: Tables) -> DataFrame:
    """Large parts have numbers already; the others get the next ones as they came in."""
    from gleaner.operators.ordering import global_rank

    given = global_rank(t.part.filter("p_size > 25").select(F.col("p_partkey").alias("id"), "p_retailprice"), [],
                        [F.asc("p_retailprice"), F.asc("id")], "no").select("id", "no")
    return C.assign_numbers(_added(t), given)


@query("o66_item_of_the_day", f"""
WITH {PARTS}, pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM shown), n AS (SELECT count(*) AS n FROM shown),
days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
picks AS (SELECT day, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(strftime(day, '%Y-%m-%d')), ''),
    lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % n) AS place FROM days, n)
SELECT strftime(day, '%Y-%m-%d') AS day, id FROM picks JOIN pool USING (place)""")
def item_of_the_day(t: Tables) -> DataFrame:
    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return C.item_of_the_day(days, _shown(t)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "id")


SEEN = """seen AS (SELECT l_partkey AS id, max(l_orderkey)::BIGINT AS "at" FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)"""


def _seen(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_orderkey").alias("at"))


@query("o64_rediscover", f"""
WITH {PARTS}, {SEEN} SELECT id, coalesce("at", 0)::BIGINT AS last_seen FROM shown LEFT JOIN seen USING (id)
ORDER BY coalesce("at", 0), md5('7:' || id), id LIMIT 12""")
def rediscover(t: Tables) -> DataFrame:
    return C.rediscover(_shown(t), _seen(t), 12, seed=7).select("id", *big("last_seen"))


@query("o74_mark_seen", f"""
WITH {SEEN}, later AS (SELECT l_partkey AS id, l_orderkey AS "at" FROM lineitem WHERE l_quantity < 5 AND l_partkey IN (SELECT p_partkey FROM part))
SELECT id, max("at")::BIGINT AS "at" FROM (SELECT * FROM seen UNION ALL SELECT * FROM later) GROUP BY id""")
def mark_seen(t: Tables) -> DataFrame:
    later = t.lineitem.filter("l_quantity < 5").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("at"))
    return C.mark_seen(_seen(t), later, _parts(t)).select("id", *big("at"))


@query("o65_feed_all", f"""
WITH {PARTS}, {SEEN} SELECT id, row_number() OVER (ORDER BY coalesce("at", 0), md5('3:' || id), id) AS pos FROM shown LEFT JOIN seen USING (id)""")
def feed_all(t: Tables) -> DataFrame:
    return C.feed_all(_shown(t), _seen(t), seed=3)


@query("o65_feed_collection", f"""
WITH {PARTS} SELECT cid, id, row_number() OVER (PARTITION BY cid ORDER BY md5('5:' || id), id) AS pos FROM coll""")
def feed_collection(t: Tables) -> DataFrame:
    return C.feed_collection(_coll(t), "shuffle", seed=5)


@query("o65_feed_item", f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings),
one AS (SELECT min(id) AS id FROM v),
near AS (SELECT v.id, round({sql.dot('v.vec', 'o.vec')}, 9) AS score FROM v, v o, one WHERE o.id = one.id AND v.id <> one.id),
top AS (SELECT * FROM near WHERE score >= 0.3)
SELECT v.id, row_number() OVER (ORDER BY v.id <> one.id, t.score IS NULL, -t.score, CASE WHEN t.score IS NULL THEN md5('1:' || v.id) ELSE '' END, v.id) AS pos
FROM v CROSS JOIN one LEFT JOIN top t ON t.id = v.id""")
def feed_item(t: Tables) -> DataFrame:
    """From the first vector on: all that are like it, then the rest shuffled."""
    first = t.vectors().agg(F.min("id")).first()[0]
    one = t.vectors().filter(F.col("id") == first).select(F.col("id").alias("query"), "vec")
    found = score_vectors(one, t.vectors(), depth=1, floor=0.3).filter((F.col("score") >= 0.3) & (F.col("id") != first))
    near = found.select(F.col("query").alias("id"), F.col("id").alias("similar"), "score")
    return C.feed_item(t.vectors(), first, near, seed=1)


@query("o56_collection_summary", f"""
WITH {PARTS}
SELECT 'all' AS cid, count(*)::BIGINT AS count, min_by(id, (-added, id)) AS cover FROM shown JOIN added USING (id)
UNION ALL SELECT c.cid::VARCHAR, count(s.id)::BIGINT, max_by(s.id, (c.pos, s.id)) FROM coll c LEFT JOIN shown s USING (id) GROUP BY c.cid""")
def collection_summary(t: Tables) -> DataFrame:
    return C.collection_summary(_coll(t), _shown(t), _added(t))


@query("o57_collection_view", f"""
WITH {PARTS} SELECT cid, id, row_number() OVER (PARTITION BY cid ORDER BY pos DESC, id DESC) AS pos FROM coll JOIN shown USING (id)""")
def collection_view(t: Tables) -> DataFrame:
    return C.collection_view(_coll(t), _shown(t), "new")


@query("o57_collection_all", f"""
WITH {PARTS} SELECT id, row_number() OVER (ORDER BY added DESC, id DESC) AS pos FROM shown JOIN added USING (id)""")
def collection_all(t: Tables) -> DataFrame:
    return C.collection_all(_shown(t), _added(t))


@query("o57_collection_waiting", f"""
WITH {PARTS} SELECT cid, count(*) FILTER (id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 30))::BIGINT AS waiting FROM coll GROUP BY cid""")
def collection_waiting(t: Tables) -> DataFrame:
    """Small parts are indexed, the others wait."""
    return C.collection_waiting(_coll(t), t.part.filter("p_size <= 30").select(F.col("p_partkey").alias("id")))


@query("o71_add_to_collections", f"""
WITH {PARTS},
old AS (SELECT l_orderkey AS cid, l_partkey AS id, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
new AS (SELECT l_orderkey AS cid, l_partkey AS id, min(l_suppkey) AS pos FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2)
SELECT cid, pos::BIGINT AS pos, id FROM old UNION ALL
SELECT n.cid, (coalesce((SELECT max(pos) FROM old o WHERE o.cid = n.cid), 0) + row_number() OVER (PARTITION BY n.cid ORDER BY n.pos, n.id))::BIGINT, n.id
FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.cid = n.cid AND o.id = n.id)""")
def add_to_collections(t: Tables) -> DataFrame:
    """Returned lines are in; the others are added in the order of their supplier."""
    old = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("cid"), F.col("l_partkey").alias("id")).agg(
        F.min("l_linenumber").alias("pos"))
    new = t.lineitem.filter("l_returnflag <> 'A'").select(
        F.col("l_orderkey").alias("cid"), F.col("l_suppkey").alias("pos"), F.col("l_partkey").alias("id"))
    return C.add_to_collections(old, new)


@query("o72_remove_from_collections", f"""
WITH {PARTS} SELECT cid, id, pos FROM coll c WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.cid AND l.l_partkey = c.id AND l.l_quantity < 10)
  AND id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def remove_from_collections(t: Tables) -> DataFrame:
    """Small lines leave their order; parts of size one leave every order."""
    small = t.lineitem.filter("l_quantity < 10").select(F.col("l_orderkey").alias("cid"), F.col("l_partkey").alias("id"))
    gone = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("id"))
    return C.remove_from_collections(C.remove_from_collections(_coll(t), small), gone).select("cid", "id", "pos")


@query("o76_remove_items", """
SELECT DISTINCT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN 'reject' ELSE 'hide' END AS action
FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_discount >= 0.09""")
def remove_items(t: Tables) -> DataFrame:
    asked = t.lineitem.filter("l_discount >= 0.09").select(F.col("l_partkey").alias("id"))
    items = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_type") == "ECONOMY").alias("in_inbox"))
    return C.remove_items(asked, items)


@query("o26_item_page", f"""
WITH {PARTS},
came AS (SELECT id, min_by(site, ("at", seq)) AS site, min_by(page_url, ("at", seq)) AS page_url, count(*) AS n FROM prov GROUP BY id),
held AS (SELECT id, count(DISTINCT cid) AS n FROM coll GROUP BY id)
SELECT p_partkey AS id, c.site, c.page_url, coalesce(c.n, 0)::BIGINT AS n_sources, coalesce(h.n, 0)::BIGINT AS n_collections,
  false AS liked, p_size::BIGINT AS no, p_name AS name
FROM part LEFT JOIN came c ON c.id = p_partkey LEFT JOIN held h ON h.id = p_partkey""")
def item_page(t: Tables) -> DataFrame:
    numbers = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("no"))
    names = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return C.item_page(_parts(t).select("id"), _prov(t), _coll(t), numbers, names)


@query("o09_export_collections", f"""
WITH {PARTS},
distinct_src AS (SELECT id, site, page_url, min(("at", seq)) AS first FROM prov WHERE site <> 'site2' GROUP BY id, site, page_url),
src AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first, site, page_url) AS source_pos FROM distinct_src),
ordered AS (SELECT cid, id, row_number() OVER (PARTITION BY cid ORDER BY pos, id) AS pos FROM coll JOIN shown USING (id))
SELECT cid, pos, id, source_pos, site, page_url FROM ordered LEFT JOIN src USING (id)""")
def export_collections(t: Tables) -> DataFrame:
    """Every order with its parts' sources; what came from the third site was shared before."""
    prov = _prov(t).withColumn("site", F.when(F.col("site") == "site2", C.SHARE_SITE).otherwise(F.col("site")))
    return C.export_collections(_coll(t), _shown(t), prov).select("cid", "pos", "id", "source_pos", "site", "page_url")


@query("o10_import_status", f"""
WITH {PARTS},
x AS (SELECT c.cid, c.pos, c.id, p.p_type <> 'PROMO' AND p.p_size * 1000000 <= 20 * 1024 * 1024 AS ok, p.p_type = 'ECONOMY' AS have
      FROM coll c JOIN part p ON p.p_partkey = c.id),
f AS (SELECT id, min((cid, pos)) AS first FROM x WHERE ok GROUP BY id)
SELECT cid, pos, id, CASE WHEN NOT ok THEN 'skipped' WHEN have OR (cid, pos) <> first THEN 'duplicate' ELSE 'added' END AS status
FROM x LEFT JOIN f USING (id)""")
def import_status(t: Tables) -> DataFrame:
    """All orders imported: economy parts are there already, promo and large ones cannot be used."""
    meta = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("bigint") * 1000000).alias("size"), (F.col("p_type") != "PROMO").alias("ok"))
    have = t.part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("id"))
    return C.import_status(_coll(t).join(meta, "id"), have)


@query("o10_free_names", """
WITH x AS (SELECT c_custkey AS cid, c_mktsegment AS base, (n.seg IS NOT NULL)::INT + row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS n
  FROM customer LEFT JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_acctbal > 9995) n ON n.seg = c_mktsegment)
SELECT cid, CASE WHEN n = 0 THEN base WHEN n = 1 THEN base || '（分享）' ELSE base || '（分享 ' || n || '）' END AS name FROM x""")
def free_names(t: Tables) -> DataFrame:
    """Each customer shares a collection called by its segment; rich customers' segments are taken."""
    wanted = t.customer.select(F.col("c_custkey").alias("cid"), F.col("c_mktsegment").alias("name"))
    taken = t.customer.filter("c_acctbal > 9995").select(F.col("c_mktsegment").alias("name")).distinct()
    return C.free_names(wanted, taken)


# Stages of enrichment: events as rows, errors as failures.

@query("o24_pending", """
SELECT doc_id AS id FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))""")
def pending(t: Tables) -> DataFrame:
    """Done means done in both stages: a good label and a clean one."""
    first = t.labels.filter("quality = 1").select(F.col("doc_id").alias("id"))
    second = t.labels.filter("toxic = 0").select(F.col("doc_id").alias("id"))
    return E.pending(t.documents.select(F.col("doc_id").alias("id")), [first, second])


@query("o55_failure_counts", """
SELECT 'k' || (json_extract(props, '$.k')::BIGINT % 3) AS stage, count(*)::BIGINT AS rows, count(*) FILTER (event_type = 'error')::BIGINT AS failed
FROM events GROUP BY 1""")
def failure_counts(t: Tables) -> DataFrame:
    return E.failure_counts(_stages(t))


def _stages(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.concat(F.lit("k"), k % 3).alias("stage"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), k)).alias("error"), "value")


@query("o55_drop_failures", "SELECT event_id AS id, value FROM events WHERE event_type <> 'error'")
def drop_failures(t: Tables) -> DataFrame:
    return E.drop_failures(_stages(t)).select("id", "value")


@query("o75_merge_stage", """
SELECT vec_id AS id, 2 AS run FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) AND vec_id IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT doc_id, 1 FROM labels WHERE NOT (quality = 0 AND doc_id IN (SELECT vec_id FROM embeddings))""")
def merge_stage(t: Tables) -> DataFrame:
    """A second run over what the first got wrong."""
    first = t.labels.select(F.col("doc_id").alias("id"), F.lit(1).alias("run"))
    again = t.labels.filter("quality = 0").select(F.col("doc_id").alias("id")).join(t.vectors().select("id"), "id", "left_semi")
    return E.merge_stage(first, again.withColumn("run", F.lit(2)), t.docs())


@query("o92_reconcile", """
SELECT vec_id AS id FROM embeddings WHERE label < 6 AND len(embedding) = 64""")
def reconcile(t: Tables) -> DataFrame:
    """Labels under three are the model's own vectors, under six a smaller copy's; the rest another model's."""
    model = F.when(F.col("label") < 3, "m").when(F.col("label") < 6, "m@small").otherwise("other")
    return E.reconcile(t.vectors().withColumn("model", model), "m@large", 64).select("id")


@query("o61_changed_rows", """
SELECT doc_id AS id, sha256('m' || chr(1) || text) AS fingerprint FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def changed_rows(t: Tables) -> DataFrame:
    """Documents labelled good were embedded from the same text, those labelled bad from another."""
    before = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("id"), E.row_fingerprint(F.lit("m"), F.when(F.col("quality") == 1, F.col("text")).otherwise("")).alias("fingerprint"))
    return E.changed_rows(t.docs(), before, "m").select("id", "fingerprint")


@query("o61_set_fingerprint", """
WITH r AS (SELECT sha256('m' || chr(1) || doc_id || chr(1) || text) AS h FROM documents),
m AS (SELECT count(*) AS n, bit_xor(('0x' || substring(h, 1, 15))::BIGINT) AS x, sum(('0x' || substring(h, 16, 15))::BIGINT) AS s FROM r)
SELECT n::BIGINT AS n, sha256(n || ':' || x || ':' || s) AS fingerprint FROM m""")
def set_fingerprint(t: Tables) -> DataFrame:
    return E.set_fingerprint(t.docs(), "m")

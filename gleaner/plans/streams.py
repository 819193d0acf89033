"""Streaming and enrichment queries over the given tables, drained and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import enrichment as E
from gleaner.operators.library import Stage, Store, update
from gleaner.plans import sql
from gleaner.plans.logs import DAY, LOG, search_events
from gleaner.plans.registry import Tables, query, six
from gleaner.session import scratch
from gleaner.streaming import flows
from gleaner.streaming.sessions import sessionize_stream


IDLE = 2e9  # seconds: longer than any log, so that only a next session or the end of the log ends one


def _stream(t: Tables, name: str) -> DataFrame:
    return flows.read_table(t.spark, f"{t.folder}/{name}*.parquet", getattr(t, name).schema)


def _drained(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(t.spark, name)
    flows.append_to(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _ended(t: Tables, source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, last: dict | None = None) -> DataFrame:
    """What `build` makes of a stream: drained, then ended and drained again, so that nothing stays open."""
    path = scratch(t.spark, name)
    stream = build(flows.with_end(source, f"{path}/end"))
    flows.append_to(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    flows.end(t.spark, source.schema, f"{path}/end", **(last or {}))
    flows.append_to(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _updated(t: Tables, stream: DataFrame, name: str, key: str) -> DataFrame:
    path = scratch(t.spark, name)
    flows.updates_to(stream, f"{path}/rows", f"{path}/state").awaitTermination()
    return flows.latest_updates(t.spark.read.parquet(f"{path}/rows"), key)


def _events(t: Tables) -> DataFrame:
    return _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("o99_bursts", """
WITH e AS (SELECT user_id AS source, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
b AS (SELECT source, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM g GROUP BY source, run)
SELECT source, epoch_us(start) AS start_us, epoch_us(stop) AS stop_us, n::BIGINT AS n FROM b""")
def bursts(t: Tables) -> DataFrame:
    """Runs of one user's events with less than six hours between them, the last ones included."""
    source = _events(t).select(F.col("user_id").alias("source"), "ts")
    return _ended(t, source, lambda s: flows.bursts(s, "6 hours"), "bursts").select("source", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("stop_us"), "n")


@query("o100_first_arrivals", "SELECT DISTINCT user_id, props FROM events")
def first_arrivals(t: Tables) -> DataFrame:
    stream = flows.first_arrivals(_events(t).select("ts", "user_id", "props"), ["user_id", "props"], "3650 days")
    return _drained(t, stream, "arrivals").select("user_id", "props")


@query("o101_decisions_stream", """
SELECT json_extract(props, '$.k')::BIGINT AS id, max_by(CASE WHEN event_type IN ('view', 'click') THEN 'keep' ELSE 'reject' END, (ts, event_id)) AS decision
FROM events GROUP BY 1""")
def decisions_stream(t: Tables) -> DataFrame:
    """Events as decisions on their k; the last one counts."""
    decision = F.when(F.col("event_type").isin("view", "click"), "keep").otherwise("reject")
    log = _events(t).select(F.get_json_object("props", "$.k").cast("bigint").alias("id"), decision.alias("decision"),
                            F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return _updated(t, flows.decisions_now(log), "decisions", "id").select("id", "decision")


@query("o102_last_seen", "SELECT user_id AS id, max(event_id) AS \"at\" FROM events GROUP BY user_id")
def last_seen(t: Tables) -> DataFrame:
    stream = flows.last_seen(_stream(t, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at")))
    return _updated(t, stream, "seen", "id").select("id", "at")


@query("o103_sessionize_stream", f"""
WITH RECURSIVE {LOG} SELECT usr AS "user", q, round(start_t, 3) AS start_t, start_seq, n_acted::BIGINT AS n_acted, first_acted
FROM rows1""")
def sessionize_stream_query(t: Tables) -> DataFrame:
    """All sessions: those over because the user's next one has started, and each user's last when the log ends."""
    log = search_events(_stream(t, "events")).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    found = _ended(t, log, lambda s: sessionize_stream(s, gap=DAY, delay="0 seconds", idle=IDLE), "sessions", {"t": flows.FAR.timestamp(), "seq": 0})
    return found.withColumn("start_t", F.round("start_t", 3))


@query("o104_search_rates", """
WITH w AS (SELECT date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'view') AS searches,
             count(*) FILTER (event_type IN ('click', 'purchase')) AS acts FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1)
SELECT epoch_us(start) AS start_us, searches::BIGINT AS searches, acts::BIGINT AS acts,
  CASE WHEN searches > 0 THEN round(acts / searches, 6) END AS acted_rate
FROM w""")
def search_rates(t: Tables) -> DataFrame:
    log = search_events(_stream(t, "events")).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    rates = _ended(t, log.select("ts", "type"), flows.search_rates, "rates").filter(F.col("start") < F.lit(flows.FAR))
    return rates.select(F.unix_micros("start").alias("start_us"), "searches", "acts", *six("acted_rate"))


@query("o105_live_match", f"WITH {sql.LEXICAL} SELECT query, id, round(share, 6) AS share FROM lexical WHERE share >= 0.5")
def live_match(t: Tables) -> DataFrame:
    """Documents as they come in, against all questions."""
    path = scratch(t.spark, "live")
    docs = _stream(t, "documents").select(F.col("doc_id").alias("id"), "text")
    flows.live_match(docs, t.questions(), f"{path}/index", f"{path}/matches", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/matches").select("query", "id", *six("share"))


def _count_words():
    def fn(text: str) -> int:
        if "Licensed" in text:
            raise ValueError("licence text")
        return len(text.split(" "))

    return fn


def _count_many():
    one = _count_words()
    return lambda texts: [one(x) for x in texts]


WORDS = """SELECT doc_id AS id, CASE WHEN NOT contains(text, 'Licensed') THEN len(string_split(text, ' '))::BIGINT END AS value,
  CASE WHEN contains(text, 'Licensed') THEN 'ValueError: licence text' END AS error FROM documents"""


@query("o90_enrich", WORDS)
def enrich(t: Tables) -> DataFrame:
    """A function that fails on some documents."""
    return E.enrich(t.docs(), _count_words, "id", "bigint", ["text"], "words")


@query("o91_enrich_batched", WORDS)
def enrich_batched(t: Tables) -> DataFrame:
    return E.enrich_batched(t.docs(), _count_many, "id", "bigint", "text", 16, "words-many")


STAGES = [Stage("words", _count_words, "text", "bigint", "m1"), Stage("words_many", _count_many, "text", "bigint", "m1", batch=16)]


@query("o94_update", """
SELECT s AS stage, count(*)::BIGINT AS rows, count(*) FILTER (contains(text, 'Licensed'))::BIGINT AS failed
FROM documents CROSS JOIN (VALUES ('words'), ('words_many')) v(s) GROUP BY s""")
def update_twice(t: Tables) -> DataFrame:
    """First the labelled documents, then all: the second run only works on the others."""
    store = Store(t.spark, scratch(t.spark, "library"))
    labelled = t.docs().join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi")
    update(labelled, STAGES, store, "1")
    return update(t.docs(), STAGES, store, "2")


@query("o98_watch_sources", WORDS)
def watch_sources(t: Tables) -> DataFrame:
    """New files bring the stage up to date, batch by batch."""
    path = scratch(t.spark, "watch")
    store = Store(t.spark, path)

    def run(batch: DataFrame, number: int) -> None:
        update(batch.select(F.col("doc_id").alias("id"), "text"), STAGES[:1], store, f"b{number}")

    flows.each_batch(_stream(t, "documents"), run, f"{path}/state").awaitTermination()
    return store.read("words", "id bigint, value bigint, error string, model string").select("id", "value", "error")

"""Streams fed in several batches, partly out of order, against their batch twins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical
from gleaner.operators import searchlog as L
from gleaner.streaming import flows
from gleaner.streaming.sessions import sessionize_stream

SCHEMA = "user string, t double, seq bigint, type string, q string, id bigint"


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(11)
    n = 800
    return pd.DataFrame({
        "user": np.where(rng.random(n) < 0.4, "busy", rng.integers(0, 8, n).astype(str)), "t": np.sort(rng.integers(0, 20000, n)).astype(float),
        "seq": np.arange(n), "type": np.where(rng.random(n) < 0.5, "search", "act"), "q": rng.integers(0, 2, n).astype(str), "id": rng.integers(0, 4, n)})


def _feed(spark, frame, folder, batches, shuffle=0):
    """Files in the order a stream takes them; rows may move to a neighbouring file."""
    rng = np.random.default_rng(2)
    place = np.clip(np.arange(len(frame)) + rng.integers(-shuffle, shuffle + 1, len(frame)), 0, len(frame) - 1)
    parts = np.array_split(frame.iloc[np.argsort(place, kind="stable")], batches)
    folder.mkdir()
    import os

    for n, part in enumerate(parts):
        part.to_parquet(folder / f"{n:03}.parquet")
        os.utime(folder / f"{n:03}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


@pytest.mark.parametrize("batches,shuffle", [(1, 0), (6, 0), (6, 20)])
def test_sessions(spark, log, tmp_path, batches, shuffle):
    _feed(spark, log, tmp_path / "in", batches, shuffle)
    end = pd.DataFrame({"user": ["end"], "t": [9e6], "seq": [10**6], "type": ["search"], "q": ["x"], "id": [0]})
    end.to_parquet(tmp_path / "in" / "999.parquet")
    stream = flows.read_table(spark, str(tmp_path / "in"), SCHEMA, 1).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    out = sessionize_stream(stream, gap=180, delay="3000 seconds", idle=1e5)
    flows.append_to(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    cols = ["user", "q", "start_t", "start_seq", "n_acted", "first_acted"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*cols).collect()}
    want = L.sessions(L.attach_sessions(spark.createDataFrame(log, SCHEMA), gap=180)).select(*cols)
    assert got == {tuple(r) for r in want.collect()}


def test_a_session_left_alone_is_given_out(spark, tmp_path):
    rows = pd.DataFrame({"user": ["a", "a", "b"], "t": [1000.0, 1050.0, 90000.0], "seq": [0, 1, 2], "type": ["search", "act", "search"], "q": ["x", "x", "y"], "id": [0, 7, 0]})
    _feed(spark, rows, tmp_path / "in", 3)
    stream = flows.read_table(spark, str(tmp_path / "in"), SCHEMA, 1).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")))
    flows.append_to(sessionize_stream(stream, idle=3600, delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.user, r.n_acted, r.first_acted) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1, 7)]


def test_decisions_and_last_seen_over_batches(spark, log, tmp_path):
    _feed(spark, log, tmp_path / "in", 5, 40)
    stream = flows.read_table(spark, str(tmp_path / "in"), SCHEMA, 1)
    decided = flows.decisions_now(stream.select("id", F.col("type").alias("decision"), F.col("t").alias("at"), "seq"))
    flows.updates_to(decided, str(tmp_path / "d"), str(tmp_path / "ds")).awaitTermination()
    got = {r.id: r.decision for r in flows.latest_updates(spark.read.parquet(str(tmp_path / "d")), "id").collect()}
    assert got == log.sort_values(["t", "seq"]).groupby("id")["type"].last().to_dict()
    seen = flows.last_seen(flows.read_table(spark, str(tmp_path / "in"), SCHEMA, 1).select("id", F.col("t").alias("at")))
    flows.updates_to(seen, str(tmp_path / "s"), str(tmp_path / "ss")).awaitTermination()
    got = {r.id: r.at for r in flows.latest_updates(spark.read.parquet(str(tmp_path / "s")), "id").collect()}
    assert got == log.groupby("id")["t"].max().to_dict()


def test_new_files_are_seen_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"a")
    seen = []

    def run():
        stream = flows.read_files(spark, str(tmp_path / "in"))
        flows.each_batch(stream, lambda df, n: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.collect()), str(tmp_path / "state")).awaitTermination()

    run()
    (tmp_path / "in" / "b.png").write_bytes(b"b")
    run()
    assert seen == ["a.png", "b.png"]


def test_documents_are_matched_as_they_come(spark, tmp_path):
    words = "red green blue cold warm tall small".split()
    rng = np.random.default_rng(4)
    docs = pd.DataFrame({"id": np.arange(30), "text": [" ".join(rng.choice(words, 6)) for _ in range(30)]})
    _feed(spark, docs, tmp_path / "in", 3)
    queries = spark.createDataFrame([(1, "red green"), (2, "warm cold small"), (3, "odd")], "query int, text string")
    stream = flows.read_table(spark, str(tmp_path / "in"), "id bigint, text string", 1)
    flows.live_match(stream, queries, str(tmp_path / "index"), str(tmp_path / "m"), str(tmp_path / "state"), floor=0.1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.select("batch").distinct().count() == 3
    last = {(r.query, r.id): round(r.share, 9) for r in got.filter("batch = 2").collect()}
    whole = lexical.lexical_score(queries, spark.createDataFrame(docs)).filter("share >= 0.1 AND id >= 20")
    assert last == {(r.query, r.id): round(r.share, 9) for r in whole.collect()}
    # later probes of the stored postings equal scoring all documents
    stored = spark.read.parquet(str(tmp_path / "index" / "postings"))
    probed = lexical.score_postings(queries, stored, stored.select("id").distinct().agg(F.count("*").alias("n")))
    full = {(r.query, r.id): round(r.share, 9) for r in lexical.lexical_score(queries, spark.createDataFrame(docs)).collect()}
    assert {(r.query, r.id): round(r.share, 9) for r in probed.collect()} == full

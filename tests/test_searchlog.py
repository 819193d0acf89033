"""Sessions: hand-made logs, and busy users spread over many partitions against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import searchlog as L

SCHEMA = "user string, t double, seq bigint, type string, q string, id string, matches array<string>, maybe array<string>"


def _events(spark, rows):
    full = [(u, float(t), n, kind, q, i, m, y) for n, (u, t, kind, q, i, m, y) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def _search(t, q, matches=(), maybe=(), user="u"):
    return (user, t, "search", q, None, list(matches), list(maybe))


def _act(t, q, i, user="u"):
    return (user, t, "act", q, i, None, None)


LOG = [
    _search(0, "礁石", ["a"], ["b"]), _search(8, "礁石", ["a"], ["b"]), _act(9, "礁石", "b"), _act(11, "礁石", "b"),
    _search(500, "那座桥", ["x"]), _search(530, "木桥", ["c", "d"]), _act(545, "木桥", "c"), _search(1000, "渡船"), _act(1040, "礁石", "z"),
]


def test_sessions_summary_and_export(spark):
    attached = L.attach_sessions(_events(spark, LOG))
    rows = L.with_next(L.sessions(attached))
    got = [(r.q, r.n_acted, r.first_acted, r.rephrased) for r in rows.orderBy("start_t").collect()]
    assert got == [("礁石", 1, "b", False), ("那座桥", 0, None, True), ("木桥", 1, "c", False), ("渡船", 0, None, False)]
    assert tuple(L.search_summary(rows).first()) == (4, 2, 1, 1, 1, 1, 2)
    relpaths = spark.createDataFrame([("b", "b.png"), ("c", "c.png")], "id string, relpath string")
    out = {r.query: r.expected for r in L.export_queries(L.wanted_items(attached, rows), relpaths).collect()}
    assert out == {"礁石": "b.png", "那座桥": "c.png", "木桥": "c.png"}


def test_the_gap_counts_from_the_start_of_the_session(spark):
    rows = L.sessions(L.attach_sessions(_events(spark, [_search(t, "q") for t in (0, 100, 190)]), gap=180))
    assert sorted(r.start_t for r in rows.collect()) == [0.0, 190.0]


def _plain(events, gap):
    """What the rules say, one event at a time."""
    out, open_ = {}, {}
    for u, t, seq, kind, q, _ in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        last = open_.get(u)
        if kind == "search":
            if not (last and last[0] == q and t - last[1] < gap):
                open_[u] = (q, t, seq)
            out[seq] = open_[u][2]
        else:
            out[seq] = last[2] if last and last[0] == q else None
    return out


@pytest.mark.parametrize("queries,partitions", [(1, 12), (2, 12), (3, 5), (3, 1)])
def test_busy_users_over_many_partitions(spark, queries, partitions):
    """One user holds most events; with a single query whole partitions depend on the one before."""
    rng = np.random.default_rng(queries)
    events = []
    for n in range(3000):
        u = "busy" if rng.random() < 0.7 else f"u{rng.integers(0, 20)}"
        events.append((u, float(rng.integers(0, 40000)) / 10, n, "search" if rng.random() < 0.6 else "act", f"q{rng.integers(0, queries)}", int(rng.integers(0, 5))))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(events, "user string, t double, seq bigint, type string, q string, id int")
        got = {r.seq: r.start_seq for r in L.attach_sessions(df, gap=9.5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == _plain(events, 9.5)


def test_valid_actions(spark):
    rows = [(" q ", "open", 3, "matches", "a"), ("", "open", 1, "maybe", "a"), ("q", "stare", 1, "maybe", "a"),
            ("q", "like", 10000, "side", "a"), ("x" * 201, "open", 1, "maybe", "a"), ("q", "copy", None, None, "gone")]
    df = spark.createDataFrame(rows, "q string, action string, rank int, section string, id string")
    known = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in L.valid_actions(df, known).orderBy("action").select("q", "action", "rank", "section").collect()] == [
        ("q", "like", None, None), ("q", "open", 3, "matches")]


def test_csv_of_queries(spark, tmp_path):
    L.write_queries(spark.createDataFrame([("猫", "a;b")], "query string, expected string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().expected == "a;b"

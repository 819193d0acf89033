"""Wording, fusion and the split, on cases small enough to work out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import exact, fusion, lexical
from gleaner.plans import evaluation
from gleaner.plans.registry import Tables

def test_units_read_every_script_alike(spark):
    df = spark.createDataFrame([("誰見過？ＦＯＧ燈",)], "t string")
    got = df.select(T.units(F.col("t"), {"誰": "谁", "見": "见", "過": "过", "燈": "灯"}).alias("u")).first().u
    assert got == ["谁", "见", "过", "fog", "灯"]


def test_fusion(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)]
    got = fusion.rrf_fuse(spark.createDataFrame(rows, "query int, id string, rank int")).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)


def _library(spark):
    docs = spark.createDataFrame([("reef", "船"), ("pier", "桨"), ("grey", "")], "id string, text string")
    vec = spark.createDataFrame([("reef", [1.0, 0.0]), ("pier", [0.0, 1.0])], "id string, vec array<double>")
    queries = spark.createDataFrame([(1, "船")], "query int, text string")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "query int, vec array<double>")
    return fusion.hits(fusion.route_rankings(queries, docs, {"ocr": (qv, vec)}))


def test_split(spark):
    found = fusion.split_search(_library(spark))
    assert {(r.section, r["rank"], r.id) for r in found.collect()} == {("matches", 1, "reef"), ("maybe", 1, "pier"), ("maybe", 2, "grey")}


def test_hidden_items_keep_their_ranks_and_the_rest_is_refilled(spark):
    hidden = spark.createDataFrame([("pier",)], "id string")
    full = {r.id: r.score for r in _library(spark).collect()}
    found = fusion.split_search(_library(spark), maybe_k=1, hidden=hidden).collect()
    assert {(r.section, r.id) for r in found} == {("matches", "reef"), ("maybe", "grey")}
    assert all(r.score == full[r.id] for r in found)


def test_overlap(spark):
    rows = [("Good Morning", "oh, good morning all", 1.0), ("ab", "xy", 0.0), ("", "xy", 0.0), ("x", "axb", 1.0), ("abab", "ab", 2 / 3)]
    df = spark.createDataFrame(rows, "q string, t string, want double").select(T.norm(F.col("q")).alias("q"), T.norm(F.col("t")).alias("t"), "want")
    for r in df.select("want", T.quote_overlap(F.col("q"), F.col("t")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_patterns(spark):
    alike = [("{X}一时爽，一直{X}一直爽", "X 一时爽 一直 X 一直爽！"), ("{X} is the new {Y}.", "[X] Is The New 【Y】")]
    for r in spark.createDataFrame(alike, "a string, b string").select(T.normalize_pattern(F.col("a")).alias("a"), T.normalize_pattern(F.col("b")).alias("b")).collect():
        assert r.a == r.b and "{S}" in r.a


@pytest.mark.parametrize("seed,n,vectors,most", [(0, 500, 500, 10**6), (1, 500, 90, 10**6), (1, 500, 90, 700)])
def test_looking_at_the_first_places_only_gives_the_same_search(spark, seed, n, vectors, most, monkeypatch):
    """Many equal vectors and tied scores, items without a vector, hidden and matching items; queries in smaller passes."""
    monkeypatch.setattr(exact, "MAX_CANDIDATES", most)
    rng = np.random.default_rng(seed)
    words = np.array("red green blue cold warm tall small odd even".split())
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 5))) for i in range(n)], "id bigint, text string")

    def table(count, name):
        mat = rng.normal(size=(count, 4)).round(1)
        mat[rng.random(count) < 0.3] = mat[0]
        mat = mat / np.linalg.norm(mat, axis=1, keepdims=True)
        ids = rng.permutation(n)[:count] if name == "id" else np.arange(count)
        return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)], f"{name} bigint, vec array<double>")

    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(7)], "query bigint, text string")
    routes = {"ocr": (table(6, "query"), table(vectors, "id")), "clip": (table(5, "query"), table(vectors, "id"))}
    routes = {k: (q.cache(), v.cache()) for k, (q, v) in routes.items()}
    hidden = spark.createDataFrame([(int(i),) for i in rng.permutation(n)[: n // 3]], "id bigint")
    rankings = fusion.route_rankings(queries, docs, routes)
    cols = ["query", "id", "rank", "section"]
    rows = lambda df, cs: sorted((tuple(r[c] for c in cs), round(r["score"], 9)) for r in df.collect())
    assert rows(exact.search_top(queries, docs, routes, 10), cols[:3]) == rows(fusion.search(rankings, 10), cols[:3])
    threshold = (0.57, 0.97)[seed]
    got = exact.split_top(queries, docs, routes, 5, hidden, match_threshold=threshold)
    want = fusion.split_search(fusion.hits(rankings), 5, hidden, threshold)
    assert rows(got, cols) == rows(want, cols)


def test_passages_are_found_within_words(spark, tmp_path):
    texts = {0: "within sides of one", 1: "a passage of no more than these few words, and some", 2: "日本語の文章です🙂!", 3: "", 4: None, 5: "x"}
    asked = {0: "in sid", 1: "age of no more than these few wor", 2: "本語", 3: "文章です🙂", 4: "absent words", 5: "x", 6: None, 7: "a passage of no less than these", 8: ""}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [(r.query, r.relevant) for r in evaluation._quoted(Tables(spark, str(tmp_path))).collect()]
    want = {(q, d) for q, p in asked.items() for d, t in texts.items() if p is not None and t is not None and p in t}
    assert len(found) == len(want) and set(found) == want
    none = spark.createDataFrame([], "query bigint, text string")
    assert lexical.verbatim(none, spark.createDataFrame([(1, "a")], "id bigint, text string")).count() == 0


def test_only_texts_with_a_seed_leave_the_reading_of_the_documents(spark, tmp_path):
    """A run is compared where the text is read: no row for each run, and the metrics find the pairs written."""
    passage = "the wording that a question quotes, 日本語 too"
    texts = [(i, f"{'padding ' * 50}{i}") for i in range(50)] + [(50, f"before {passage} after"), (51, passage), (52, passage[:-1])]
    docs = spark.createDataFrame(texts, "id bigint, text string").coalesce(2)
    queries = spark.createDataFrame([(1, passage), (2, passage)], "query bigint, text string")
    found = lexical.verbatim(queries, docs)
    assert sorted(map(tuple, found.collect())) == [(1, 50), (1, 51), (2, 50), (2, 51)]
    assert "Generate explode" not in found._jdf.queryExecution().toString()
    docs.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    queries.withColumnRenamed("query", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = evaluation._quoted(Tables(spark, str(tmp_path)))._jdf.queryExecution().toString()
    assert "ExistingRDD" in plan and "documents.parquet" not in plan and "MapInArrow" not in plan


def test_seeds_do_not_reach_from_one_text_into_the_next():
    data = np.frombuffer(b"abcdefgh", dtype=np.uint8)
    every = {k: np.ones(1 << lexical._SLOT_BITS, dtype=bool) for k in (0, 1, 2, 4)}
    rows, ks, _ = lexical._seeds_held(data, np.array([0, 3, 3, 8]), every)
    assert sorted(zip(rows.tolist(), ks.tolist())) == (
        [(0, 0)] + [(0, 1)] * 3 + [(0, 2)] * 2 + [(1, 0)] + [(2, 0)] + [(2, 1)] * 5 + [(2, 2)] * 4 + [(2, 4)] * 2)

"""Ranks by blocks against plain Python, and wording found where texts are read against the grams of every text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import blocks, fusion, lexical, vectors


def _ranked(rows):
    """(key, id, rank), best first, NaN before all, then by id, null ids first."""
    found = []
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        mine.sort(key=lambda r: (-math.inf if math.isnan(r[2]) else -r[2], r[1] is not None, r[1] if r[1] is not None else 0))
        found += [(key, r[1], i + 1) for i, r in enumerate(mine)]
    return found


@pytest.mark.parametrize("id_type", ["bigint", "string"])
@pytest.mark.parametrize("run_rows", [64, 1 << 19])
def test_ranks_of_keys_cut_into_runs(spark, monkeypatch, run_rows, id_type):
    """One key has most rows, half of them with the same score; scores below zero, NaN, null ids, a null key."""
    monkeypatch.setattr(blocks, "RUN_ROWS", run_rows)
    runs = []
    monkeypatch.setattr(blocks, "_looked_up", lambda rows, lookup, on, f=blocks._looked_up: runs.append((lookup, on)) or f(rows, lookup, on))
    rng = np.random.default_rng(5)
    name = (lambda i: int(i)) if id_type == "bigint" else (lambda i: "aé日🙂"[i % 4] + str(i))
    rows = [(7, name(i), 0.5 if i % 2 else round(rng.normal(), 2)) for i in range(1500)]
    rows += [(int(q), name(i), round(rng.normal(), 1)) for q in range(3) for i in range(40)]
    rows += [(7, name(9001), math.nan), (7, None, 0.5), (None, name(3), 0.1), (None, name(4), 0.2), (7, name(9002), -0.0), (7, name(9003), 0.0)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], f"query bigint, id {id_type}, score double").repartition(5)
    got = blocks.rank_scores(df, ["query"])
    assert got.columns == ["query", "id", "score", "rank"]
    taken = [(r.query, r.id, r["rank"]) for r in got.collect()]
    assert sorted(taken, key=repr) == sorted(_ranked(rows), key=repr)
    scores = {(r[0], r[1]): r[2] for r in rows}
    assert all(r.score == scores[r.query, r.id] or math.isnan(r.score) for r in got.collect())
    placed = next(lookup for lookup, on in runs if on == ["query", "_run"])
    most = placed.filter("query = 7").count()
    assert most > 10 if run_rows == 64 else most == 1


def test_sums_of_places(spark):
    """Ids that a route ranks twice, null ids and rows without a rank; as summing and numbering row by row."""
    rng = np.random.default_rng(3)
    rows = [(int(q), None if i == 77 else int(i), int(r)) for q in range(3) for _ in range(2) for r, i in enumerate(rng.permutation(400), 1)]
    rows += [(1, 5, 9), (1, 900, 3), (2, 901, None)]
    rankings = spark.createDataFrame(rows, "query bigint, id bigint, rank bigint").repartition(6)
    want = fusion.global_rank(fusion.fuse_scores(rankings), ["query"], fusion.best_first())
    got = fusion.rrf_fuse(rankings)
    take = lambda df: sorted((r.query, str(r.id), r.score, r["rank"]) for r in df.collect())
    assert got.columns == ["query", "id", "score", "rank"] and take(got) == take(want)


def test_rounding_is_that_of_spark(spark):
    values = [1 / 61 + 1 / 63, 0.0000000000005, 0.0163934426225, 0.01639344262250049, 0.1234567890125, 0.1234567890135, 2 / 3, 0.5]
    want = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 12).alias("v")).collect()]
    assert blocks._rounded(np.array(values), 12).tolist() == want


TEXTS = [
    "red green blue", "RED  green; blue-red", "", None, "日本語 の文章", "日本 red語", "ＦＯＧ fog2 fog 2", "x² Ⅷ ½ kelvin K k", "naïve café",
    "🙂red🙂green", "blue", "green blue", "red́ green", "ß SS ﬁ fi", "İ i", "𝒜𐐀 𐐨x", "a_b a b", "red", "١٢ ab", "한글 red green",
]


def test_grams_are_found_where_texts_are_read(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "red green"), (0, "green blue")], "id bigint, text string").coalesce(1)
    for script_map in (None, {"の": "A", "日": "r"}):
        every = lexical.document_grams(docs, script_map)
        grams = [r.gram for r in every.select("gram").distinct().collect()]
        for asked in (grams, grams[::2], grams[1::2], ["absent", "red absent"]):
            want = every.filter(F.col("gram").isin(asked)).distinct()
            got = lexical.held_grams(docs, asked, script_map).distinct()
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert lexical.held_grams(docs, []).count() == 0


def test_only_wanted_grams_leave_the_reading_of_a_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red green w{i}") for i in range(20)], "id bigint, text string")
    queries = spark.createDataFrame([(1, "red green"), (2, "w3"), (3, "nothing like it"), (4, "")], "query bigint, text string")
    take = lambda df: sorted((r.query, r.id, round(r.share, 9)) for r in df.collect())
    monkeypatch.setattr(lexical, "MAX_GRAMS", 1)
    want = take(lexical.lexical_score(queries, docs))
    monkeypatch.undo()
    read = []
    monkeypatch.setattr(lexical, "document_grams", lambda *a: read.append(a))
    assert take(lexical.lexical_score(queries, docs)) == want and len(want) == 21
    assert not read


def test_items_without_a_vector_are_spread_before_each_query_repeats_them(spark):
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query bigint, vec array<double>")
    vec = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, vec array<double>")
    items = spark.range(300).coalesce(1)
    placed = vectors.absent_places(queries, vec, items)
    assert placed.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert sorted((r.query, r["rank"], r.id) for r in placed.collect()) == [(q, i + 1, i) for q in range(5) for i in range(1, 300)]

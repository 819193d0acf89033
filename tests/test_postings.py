"""Shares of wording on texts drawn at random, against a scorer that states the rule in plain Python."""

import math
import re
import unicodedata

import numpy as np
import pytest

from gleaner.functions import text as T
from gleaner.operators import lexical, postings

LETTERS = "水火木金土山川田"


def _grams(text):
    us = re.findall(f"[a-z0-9]+|[{LETTERS}]", text.lower())
    return us, [f"{a} {b}" for a, b in zip(us, us[1:])]


def plain_shares(queries, docs):
    """A query of one unit asks for it, others for their adjacent pairs; a gram weighs ln((n + 1) / (df + 1/2))."""
    held = {i: set(us) | set(ps) for i, (us, ps) in ((i, _grams(t)) for i, t in docs.items() if t)}
    out = {}
    for q, text in queries.items():
        us, ps = _grams(text or "")
        wanted = set(us) if len(us) == 1 else set(ps)
        weight = {g: math.log((len(held) + 1) / (sum(g in h for h in held.values()) + 0.5)) for g in wanted}
        for i, h in held.items():
            if wanted & h:
                out[q, i] = round(sum(weight[g] for g in wanted & h) / sum(weight.values()), 9)
    return out


def _drawn(seed, n_docs=120, n_queries=25):
    """Few words, so that shares tie; one phrase in a third of all texts; some texts null, empty or repeated."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(12)] + list(LETTERS)

    def text(length):
        return " ".join(words[int(k)] for k in rng.integers(0, len(words), length))

    docs = {i: text(int(rng.integers(1, 30))) + (" every third text" if i % 3 == 0 else "") for i in range(n_docs)}
    docs |= {n_docs: None, n_docs + 1: "", n_docs + 2: docs[5], n_docs + 3: docs[5], n_docs + 4: "?!"}
    queries = {q: text(int(rng.integers(1, 9))) for q in range(n_queries)}
    queries |= {n_queries: "every third text", n_queries + 1: "W3", n_queries + 2: "?", n_queries + 3: None, n_queries + 4: "absent words", n_queries + 5: docs[5]}
    return docs, queries


def _tables(spark, docs, queries):
    return spark.createDataFrame(list(queries.items()), "query int, text string"), spark.createDataFrame(list(docs.items()), "id int, text string")


def _pairs(rows):
    return {(r["query"], r["id"]): round(r["share"], 9) for r in rows.collect()}


@pytest.mark.parametrize("seed", [11, 12])
def test_stored_index_equals_the_plain_rule(spark, tmp_path, seed):
    docs, queries = _drawn(seed)
    q, d = _tables(spark, docs, queries)
    index = postings.write_index(d, str(tmp_path / "index"))
    want = plain_shares(queries, docs)
    assert _pairs(postings.all_shares(q, index)) == pytest.approx(want)
    assert _pairs(lexical.lexical_score(q, d)) == pytest.approx(want)
    again = postings.read_index(spark, str(tmp_path / "index"))
    for floor in (0.2, 0.75, 1.0):
        assert _pairs(postings.shares_at_least(q, again, floor)) == {k: v for k, v in want.items() if v >= floor}
    for k in (1, 7, 500):
        found = {}
        for (asked, i), share in want.items():
            found.setdefault(asked, []).append((-share, i))
        places = {(asked, i, n) for asked, rows in found.items() for n, (_, i) in enumerate(sorted(rows)[:k], 1)}
        assert {(r["query"], r["id"], r["rank"]) for r in postings.top_shares(q, again, k).collect()} == places


def test_only_documents_that_may_reach_the_bound_are_looked_up(spark, tmp_path):
    """One text holds the whole wording; the texts with its commonest pair alone must not become candidates."""
    docs = {i: "every third text" for i in range(90)} | {90: "every third text hides amber keys"}
    q, d = _tables(spark, docs, {0: "every third text hides amber keys"})
    index = postings.write_index(d, str(tmp_path / "index"))
    wording = postings.asked(q, index)
    bounds = wording.per_query((postings.F.first("total") * 0.9).alias("bound"))
    assert [r["id"] for r in postings._candidates(wording, bounds, index).collect()] == [90]
    assert {r["id"] for r in postings.top_shares(q, index, 1).collect()} == {90}


def test_empty_tables(spark, tmp_path):
    docs, queries = _drawn(13, 8, 3)
    q, d = _tables(spark, docs, queries)
    index = postings.write_index(d.limit(0), str(tmp_path / "none"))
    assert postings.top_shares(q, index, 3).count() == 0 and postings.shares_at_least(q, index, 0.5).count() == 0
    index = postings.write_index(d, str(tmp_path / "some"))
    assert postings.top_shares(q.limit(0), index, 3).count() == 0 and postings.all_shares(q.limit(0), index).count() == 0


def test_bucketed_postings_give_the_same_scores(spark):
    docs, queries = _drawn(14, 40, 6)
    q, d = _tables(spark, docs, queries)
    lexical.write_postings(d, "postings_test", 4)
    got = _pairs(lexical.score_postings(q, spark.table("postings_test"), lexical.corpus_size(d)))
    assert got == pytest.approx(plain_shares(queries, docs))
    spark.sql("DROP TABLE postings_test")


def test_pairs_beyond_a_broadcast_are_summed_from_the_lists(spark, monkeypatch):
    """The rows of the documents, which hold all grams, are neither shuffled nor read for them."""
    queries, docs = _drawn(3)
    index = postings.temporary_index(spark.createDataFrame(list(docs.items()), "id bigint, text string"))
    asked = postings.asked(spark.createDataFrame(list(queries.items()), "query bigint, text string"), index)
    pairs = spark.createDataFrame([(q, i) for q in list(queries)[::2] for i in list(docs)[::3]], "query bigint, id bigint")
    monkeypatch.setattr(postings, "BROADCAST_BYTES", 0)
    found = postings.shares_of(pairs, asked, index)
    assert "grams" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {k: v for k, v in plain_shares(queries, docs).items() if k[0] in list(queries)[::2] and k[1] in list(docs)[::3]}
    assert {(r["query"], r["id"]): round(r["share"], 9) for r in found.collect()} == want


def test_lists_are_sorted_in_small_parts(spark, monkeypatch):
    """One task's postings fit its memory however large the files of the documents are."""
    monkeypatch.setattr(postings, "SORT_BYTES", 4096)
    monkeypatch.setattr(postings, "ROW_GROUP_BYTES", 1024)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs = spark.range(1, 3001).selectExpr("id", "concat('a b c ', sha2(string(id), 256), ' ', sha2(string(-id), 256)) AS text")
    index = postings.temporary_index(docs.coalesce(1))
    assert len(index.inverted.inputFiles()) > len(index.forward.inputFiles()) == 1
    assert index.counts.filter("gram = 'a b'").first()["df"] == 3000 and index.inverted.count() == 3000 * 9
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_all_shares_sort_no_pairs(spark):
    queries, docs = _drawn(4)
    index = postings.temporary_index(spark.createDataFrame(list(docs.items()), "id bigint, text string"))
    found = postings.all_shares(spark.createDataFrame(list(queries.items()), "query bigint, text string"), index)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_settled_texts_are_told_by_one_class():
    """No character that a normalisation changes is taken as settled, and texts are matched as one run."""
    settled = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", T.SETTLED_PATTERN).replace(r"\z", r"\Z"))
    for code in (c for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        assert unicodedata.normalize("NFKC", chr(code)) == chr(code) or not settled.match(f"a\n{chr(code)}b")
    assert settled.match("Straße, naïve\n水火 ひらカナ") and not settled.match("ﬁ") and not settled.match("①")

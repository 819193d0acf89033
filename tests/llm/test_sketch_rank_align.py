"""Fingerprints, ranked search and tokenizer alignment: brute force in plain Python, edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import alignment, fingerprints, ranking


# Fingerprints

def _shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    return {hashlib.md5(" ".join(words[i:i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b, k):
    a, b = sorted(_shingles(a))[:k], sorted(_shingles(b))[:k]
    union = sorted({*a, *b})[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def _texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß😀") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 40, 300]))) for _ in range(n)]
    return texts + [None, "", " \t\n", "Five Words Are One shingle", "x" * 5000, "word " * 3000] + texts[:5]


@pytest.mark.parametrize("range_bytes", [1 << 20, 2000])
def test_fingerprints_equal_brute_force(spark, range_bytes):
    texts = _texts(60, 1)
    rows = [(3 * k, t, "x", [k]) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, sketch string, edited array<int>").repartition(5)
    got = {r["id"]: r for r in fingerprints.edited(fingerprints.with_next(table, range_bytes=range_bytes)).collect()}
    assert len(got) == len(rows)
    for k, text in enumerate(texts):
        text, following = text or "", texts[k - 1] or ""  # descending, and the last after the first
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r = got[3 * k]
        assert (r["n_chars"], r["edited"], r["next_text"]) == (len(text), edited, following)
        assert r["sketch"] == sorted(_shingles(text))[:fingerprints.K] and r["edited_sketch"] == sorted(_shingles(edited))[:fingerprints.K]
    like = fingerprints.edited(fingerprints.with_next(table)).select(
        "id", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("e"), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("n")
    )
    for r in like.collect():
        text, following = texts[r["id"] // 3] or "", texts[r["id"] // 3 - 1] or ""
        assert r["n"] == pytest.approx(_alike(text, following, fingerprints.K)) and r["e"] == pytest.approx(_alike(text, got[r["id"]]["edited"], fingerprints.K))


def test_fingerprints_of_repeated_and_missing_ids(spark):
    rows = [(None, f"no id {k % 7}") for k in range(40)] + [(5, f"same id {k % 9}") for k in range(40)] + [(9, "one"), (9, "one"), (2, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.with_next(table, range_bytes=50).collect()
    assert Counter((r["id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in rows)
    # every row is the next of exactly one
    assert Counter(r["next_text"] for r in got) == Counter(t or "" for _, t in rows)
    assert {r["next_text"] for r in got if r["id"] == 9} == {"one", next(r["next_text"] for r in got if r["id"] == 9 and r["next_text"] != "one")}
    alone = fingerprints.with_next(table.filter("doc_id = 2")).collect()
    assert [(r["text"], r["next_text"], r["sketch"]) for r in alone] == [("", "", [])]
    assert fingerprints.with_next(table.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    texts = [t or "" for t in _texts(40, 2)] + [" ".join(str(k) for k in range(4000))]
    rows = [(k % 3 if k % 3 else None, t) for k, t in enumerate(texts)]
    table = fingerprints.with_sketch(spark.createDataFrame(rows, "part int, text string"), "text", "sketch")
    merged = {r["part"]: r["sketch"] for r in fingerprints.merge(table, ["part"]).collect()}
    for part in (None, 1, 2):
        every = set().union(*[_shingles(t) for p, t in rows if p == part])
        assert merged[part] == sorted(every)[:fingerprints.K]
    ten = spark.createDataFrame([(" ".join(map(str, range(4000))), " ".join(map(str, range(2000))))], "a string, b string")
    ten = fingerprints.with_sketch(fingerprints.with_sketch(ten, "a", "x"), "b", "y")
    r = ten.select(
        fingerprints.distinct_shingles(F.col("x")).alias("n"), fingerprints.resemblance(F.col("x"), F.col("y")).alias("j"),
        fingerprints.containment(F.col("y"), F.col("x")).alias("c"), fingerprints.containment(F.col("x"), F.col("y")).alias("d"),
    ).first()
    assert abs(r["n"] / 3996 - 1) < 0.3 and abs(r["j"] - 0.5) < 0.15 and r["c"] > 0.75 and abs(r["d"] - 0.5) < 0.2


# Ranked search

def _terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def _ranked(docs, items, k):
    terms = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in terms:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                found.append((-s, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=repr)


def _corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(3000)] + ["Été", "ÄB", "x_y", "12"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30, 200]))) for _ in range(n)]
    docs = list(enumerate(texts + texts[:40] + [None, "", "...", "w1 " * 4000, "W1-w2"])) + [(None, texts[3])]
    items = [(k, " ".join(rng.sample(vocabulary, 12))) for k in range(25)] + [(100, None), (101, "absent"), (102, "w1"), (103, "w1 W1 w2")]
    return docs, items


@pytest.mark.parametrize(("k", "bucket", "blocks"), [(10, 16, 1), (50, 1024, 4)])
def test_ranking_equals_brute_force(spark, monkeypatch, k, bucket, blocks):
    docs, items = _corpus(k)
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", -(-len(items) // blocks))
    monkeypatch.setattr(ranking.search, "__defaults__", (bucket,))
    table = spark.createDataFrame([(*d, 0, "z") for d in docs], "doc_id bigint, text string, score int, item string").repartition(6)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in ranking.rank(table, asked, k=k).collect()]
    assert sorted(got, key=repr) == _ranked(docs, items, k)


def test_buckets_are_passed_over(monkeypatch):
    rng = random.Random(3)
    seen = []
    may_reach = ranking.Bucket.may_reach
    monkeypatch.setattr(ranking.Bucket, "may_reach", lambda self, *a: seen.append(len(may_reach(self, *a))) or may_reach(self, *a))
    import numpy as np
    import pyarrow as pa

    term = [sorted(rng.sample(range(50), 5)) if k % 10 else [0, 1, 2, 3, 4] for k in range(1000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(1000), pa.int64()), pa.array([200 if k % 10 else 5 for k in range(1000)], pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array([[1] * 5] * 1000, pa.list_(pa.int32()))],
        names=["id", "n", "term", "tf"],
    )
    buckets = next(ranking._chunks(iter([batch]), 1000, 100_000, 50, 50))
    assert [b.length[0] for b in buckets] == sorted([b.length[0] for b in buckets], reverse=True)
    best = ranking.Best(10, 0)
    weight_of = np.zeros(50, np.int64)
    term, weight = np.arange(5), np.full(5, 1000)
    weight_of[term] = weight
    looked = 0
    for b in buckets:
        if math.sqrt(5e6) * b.length[0] < best.floor:
            break
        looked += 1
        rows = b.may_reach(term, weight, best.floor)
        best.add(b.scores(rows, weight_of), b.ids[rows])
    assert looked < len(buckets) and list(best.id) == list(range(0, 100, 10))


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "...")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b"), (None, "c")], "item_id bigint, text string")
    for d, i in ((docs, items), (docs.limit(0), items), (docs, items.limit(0))):
        got = ranking.rank(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    one = spark.createDataFrame([(7, "c c d"), (7, "c")], "doc_id bigint, text string")
    twice = spark.createDataFrame([(None, "c"), (None, "d")], "item_id bigint, text string")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in ranking.rank(one, twice).orderBy("rank").collect()] == [(None, 1, 7), (None, 2, 7)]


# Alignment

@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
@settings(max_examples=300, deadline=None)
def test_groups_cut_at_every_common_end(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    common, want, i, j = {*a} & {*b}, [], 0, 0
    for end in sorted(common):
        p, q = a.index(end) + 1, b.index(end) + 1
        want.append((p - i, q - j))
        i, j = p, q
    assert alignment.groups(a, b) == want


def test_groups_of_long_stretches():
    a = [2 * k for k in range(1, 5000)]
    b = sorted({*a} - {2000, 2002, 7000} | {6001})
    assert sum(m for m, _ in alignment.groups(a, b)) == len(a) and [g for g in alignment.groups(a, b) if g != (1, 1)] == [(3, 1), (1, 2), (2, 1)]
    assert alignment.groups([], []) == []


@given(st.text(st.sampled_from("abzé ÀßÆªº²½×ƒǅ01'\'slltve \t\n\r.,-_<|endoftext|>"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_merges_by_rank_equal_the_tokenizer(text):
    assert CUTTER.ranks is not None
    assert CUTTER.ranks.encode_ordinary(text) == CUTTER.tokenizer.encode(text, add_special_tokens=False).ids


CUTTER = alignment.load()
ODD = [None, "", " ", "  two  spaces ", "plain English text, twice: plain English text", "naïve café 漢字 😀😀", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "\n\n\tx\r\n", "x" * 3000, "tab\there\x00nul", "w " * 2000]


def _brute(texts):
    one = Tokenizer.from_file(alignment.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    letters = alignment.byte_letters()
    rows, counts = [], Counter()
    for t in texts:
        whole = b" " + (t or "").encode()
        a, b = one.encode(" " + (t or ""), add_special_tokens=False).ids, two.encode(t or "")
        x = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        y = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(x) != whole or b"".join(y) != whole:
            rows.append(([], [], [], []))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, z))) for z in (x, y))
        common = sorted({*ends_a} & {*ends_b})
        groups = [([i for i, e in zip(a, ends_a) if lo < e <= hi], [i for i, e in zip(b, ends_b) if lo < e <= hi]) for lo, hi in zip([0, *common], common)]
        links = [(i, j) for i, e in zip(a, ends_a) for j, f in zip(b, ends_b) if e == f] if len(a) < 200 else [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        rows.append((a, b, groups, links))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_alignment_equals_brute_force(spark, max_bytes):
    stored = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()
    texts = ODD + [r["text"] for r in stored] + ODD[4:6]
    rows = [(k if k % 9 else None, t, k, "x") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, pair int, _row string")
    got = alignment.link_counts(table, max_bytes=max_bytes).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(i, *w) for (i, *_), w in zip(rows, _brute(texts))]
    assert sorted(((r["id"], *[r[c] for c in names]) for r in got), key=repr) == sorted(want, key=repr)


def test_alignment_keeps_rows_and_gives_spans(spark):
    table = spark.createDataFrame([(1, "an oddity indeed", 5), (2, None, None)], "doc_id bigint, text string, times int")
    got = {r["doc_id"]: r for r in alignment.align(table, spans=True).collect()}
    assert sum(s["a"] for s in got[1]["spans"]) == got[1]["n_a"] and sum(s["b"] for s in got[1]["spans"]) == got[1]["n_b"] and sum(got[1]["times"]) == got[1]["n_groups"]
    assert got[2]["n_a"] == 0 and got[2]["groups_sha256"] == "" and got[2]["pair"] == [] and got[2]["spans"] == []
    assert alignment.link_counts(table.limit(0)).count() == 0

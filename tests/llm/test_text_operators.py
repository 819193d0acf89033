"""Licences, lines, exact and near copies: small cases and brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import exactdedup, graph, licences, linededup, simhash

LONG = "word " * 30_000 + "end"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a line that has no document id"), (4, LONG), (4, LONG), (5, "ÀB c")]


def _docs(spark, rows, extra=""):
    """Rows of (doc_id, text), with columns whose names clash with those the operators make."""
    clash = "n_words bigint, n_lines bigint, n_dropped bigint, fp bigint, score double, _drop string, labels string"
    return spark.createDataFrame([(i, t, 7, 7, 7, 7, 0.5, "x", "y") for i, t in rows], f"doc_id bigint, text string, {clash}")


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_licence_places_and_labels(spark):
    texts = [
        "Apache License, APACHE license 2.0; see the GNU General Public License version 3",
        "Released under the MIT License. CC-BY-NC 4.0",
        "apache\nlicense", "apache licenses", "the gnu lesser general public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    rows = _docs(spark, list(enumerate(texts, 10)) + ODD)
    got = {r["doc_id"]: r for r in licences.scan(rows).collect()}
    first = got[10]
    assert (first["n_words"], first["n_base"], first["first_word"], first["last_word"]) == (14, 3, 0, 8)
    assert first["base_labels"] == "apache,gpl" and first["labels"] == "apache,gpl,gpl-3" and first["score"] == 1.0
    assert got[11]["base_labels"] == "cc-by,mit" and got[11]["labels"] == "cc-by,cc-by-nc,mit"
    assert got[12]["n_base"] == 1 and got[13]["n_base"] == 0 and got[14]["labels"] == "lgpl"
    assert got[15]["score"] == 0.5 and got[15]["labels"] == ""  # one of two mandatory phrases
    assert (got[1]["n_words"], got[1]["labels"], got[1]["first_word"], got[1]["score"]) == (0, "", None, 0.0)
    assert got[4]["n_words"] == 30_001
    assert licences.scan(rows.limit(0)).count() == 0


def test_licence_places_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "gnu general public license apache cc by mit version 2 0".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(200)]
    phrases = [p.split() for t in licences.TEMPLATES if t.base for p in t.phrases]
    for r in licences.scan(_docs(spark, rows)).collect():
        words = dict(rows)[r["doc_id"]].split()
        at = [k for p in phrases for k in range(len(words)) if words[k:k + len(p)] == p]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(at), min(at, default=None), max(at, default=None))


def _kept_lines(rows, least=20, docs=3):
    def key(line):
        return _lower(line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for i, t in rows:
        for line in set(map(key, (t or "").split("\n"))):
            if i is not None and len(line) >= least:
                held.setdefault(line, set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("bits", [1 << 10, 1 << 20])
def test_line_dedup_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    pool = [f"a line of the pool with number {k}" for k in range(60)] + ["short", "", "  Épreuve de la ligne partagée ", "ÉPREUVE de la ligne partagée"]
    rows = [(i, "\n".join(rng.choice(pool).swapcase() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(80)]
    rows += ODD + [(100 + k, "seen by all of them, again and again\nown " + str(k) * 25) for k in range(30)]
    got = linededup.line_dedup(_docs(spark, rows).repartition(5), max_bits=bits).collect()
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got), key=repr)
    assert found == sorted(_kept_lines(rows), key=repr)
    assert linededup.line_dedup(_docs(spark, rows).limit(0)).count() == 0


def test_line_dedup_twice_changes_nothing_more(spark):
    rows = [(i, f"the very same line for everybody\nline number {i} of its own kind") for i in range(9)]
    once = linededup.line_dedup(_docs(spark, rows)).select("doc_id", "text")
    assert sum(r["n_dropped"] for r in linededup.line_dedup(once).collect()) == 0


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(_norm(t), []).append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, keep[_norm(t)], len(groups[_norm(t)]), i == keep[_norm(t)], hashlib.sha256(_norm(t).encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force(spark, tmp_path, weak):
    """With a digest of four values every text meets others, and only their bytes tell them apart."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "\t", "\n"]) for _ in range(rng.randrange(6)))) for i in range(150)] + ODD
    _docs(spark, rows).repartition(4).write.parquet(f"{tmp_path}/docs")

    def two_bits(text):
        return F.unhex(F.lpad(F.hex(F.pmod(F.crc32(text), F.lit(4))), 2, "0"))

    digest = two_bits if weak else exactdedup.sha256_of
    got = exactdedup.dedup(spark, f"{tmp_path}/docs", f"{tmp_path}/state", digest=digest, files_per_batch=2)
    found = sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=repr)
    assert found == _exact(rows)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    _docs(spark, [(5, "x  y"), (6, "z")]).write.parquet(f"{tmp_path}/docs")
    exactdedup.dedup(spark, f"{tmp_path}/docs", f"{tmp_path}/state").collect()
    _docs(spark, [(2, "x y"), (7, "x\ty")]).write.mode("append").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    keepers = exactdedup.update_state(spark, f"{tmp_path}/docs", docs.schema, f"{tmp_path}/state")
    assert sorted((r["keep_id"], r["group_size"]) for r in keepers.collect()) == [(2, 3), (6, 1)]
    again = exactdedup.update_state(spark, f"{tmp_path}/docs", docs.schema, f"{tmp_path}/state")
    assert sorted((r["keep_id"], r["group_size"]) for r in again.collect()) == [(2, 3), (6, 1)]


def test_exact_dedup_of_nothing(spark, tmp_path):
    _docs(spark, []).write.parquet(f"{tmp_path}/docs")
    assert exactdedup.dedup(spark, f"{tmp_path}/docs", f"{tmp_path}/state").collect() == []


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, near):
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash_equals_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice("red blue green low high far near old new odd even".split()) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one TWO"), (None, "one two"), (4, rows[4][1]), (105, LONG)]
    got = {(r["id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.near_groups(_docs(spark, rows)).collect()}
    fps = {i: _fingerprint(t) for i, t in rows if i is not None}
    root = _components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {(i, fps[i]): root[i] for i in fps} | {(None, fps[103]): 103} == got
    assert simhash.near_groups(_docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("agree", [2, 3])
def test_simhash_links_lose_none(spark, agree):
    """Chains and clusters of fingerprints at 0 to 6 bits, more of them under one key than a block holds."""
    rng = random.Random(agree)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                f ^= 1 << b
            fps.add(f)
    fps |= {(1 << 40) + k for k in range(120)}
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = graph.components(simhash.links(table, agree=agree, block=16)).collect()
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[max(top(a), top(b))] = min(top(a), top(b))
    got = {f: f for f in fps} | {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    groups = lambda m: sorted(sorted(x for x in m if m[x] == y) for y in set(m.values()))
    assert groups(got) == groups({f: top(f) for f in fps})


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(200, 210), (210, 205), (300, 300), (40, 0)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {205: 200, 210: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []

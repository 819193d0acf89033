"""Ranked lexical search over impact vectors in buckets of like length.

A document is a vector of integer impacts, one for each term a query asks for. Vectors are taken longest first in
buckets; a query passes over a bucket whose longest vector cannot reach its threshold (Cauchy-Schwarz). Inside a
bucket the query's heaviest coordinates are looked up first: what they give, and the bound on the rest by the lengths
that remain, says which vectors may still reach it. Only these are scored, in integers. A first pass over every
task's longest vectors gives thresholds that hold for all tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordering import top_k
from gleaner.session import scratch

K = 50
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20  # of queries that are asked in one pass, on average
BUCKET = 1024  # vectors of a bucket
CHUNK = 1 << 22  # coordinates a task sorts by length at a time
FOCUS = 6  # heaviest coordinates of a query that are looked up before the rest is bounded
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8: digits, letters and all that is not ASCII
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, only A-Z lower-cased; null has none."""
    return _TERM.findall(text.lower()) if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Of terms that stand `tf` times in documents of `n` terms, all in 64-bit integers."""
    m = 50 + (50 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Queries:
    """Items of one block: `term[first[k]:first[k + 1]]` are the terms of item k by descending weight."""

    items: list
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    least: np.ndarray  # of each item: a score that k documents reach

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.term[self.first[k]:self.first[k + 1]], self.weight[self.first[k]:self.first[k + 1]]


def vectors(docs: DataFrame, id: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, term, tf): of every document its number of terms, and how often it holds those of `vocabulary`."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            n, count, term, tf = [], [0], [], []
            for t in batch.column(1).cast(pa.binary()):
                found = terms_of(t.as_py())
                at = np.array([p for p in map(place, found) if p is not None], np.int32)
                k, times = np.unique(at, return_counts=True)
                n.append(len(found))
                count.append(len(k))
                term.append(k)
                tf.append(times)
            ends = pa.array(np.cumsum(count), pa.int32())
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in flat]],
                names=["id", "n", "term", "tf"],
            )

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text)).mapInArrow(work, "id bigint, n bigint, term array<int>, tf array<int>")


class Bucket:
    """Vectors of like length, by rows and by coordinates."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, term: np.ndarray, impact: np.ndarray, length: np.ndarray, n_terms: int):
        self.ids, self.start, self.term, self.impact, self.length = ids, start, term, impact, length
        row = np.repeat(np.arange(len(ids)), np.diff(start))
        order = np.argsort(term, kind="stable")
        self.row, self.by_term = row[order], impact[order]
        self.edge = np.searchsorted(term[order], np.arange(n_terms + 1))

    def may_reach(self, term: np.ndarray, weight: np.ndarray, floor: int) -> np.ndarray:
        """Rows whose bound reaches the floor: the heaviest coordinates exactly, the others by the lengths left."""
        if floor <= 0:
            return np.arange(len(self.ids))
        got, used = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for t, w in zip(term[:FOCUS].tolist(), weight[:FOCUS].tolist(), strict=True):
            part = slice(self.edge[t], self.edge[t + 1])
            got[self.row[part]] += w * self.by_term[part]
            used[self.row[part]] += self.by_term[part].astype(float) ** 2
        rest = math.sqrt(float((weight[FOCUS:].astype(float) ** 2).sum()))
        bound = got + rest * np.sqrt(np.maximum(self.length**2 - used, 0))
        return np.flatnonzero(bound * (1 + 1e-9) + 1e-3 >= floor)

    def scores(self, rows: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of these rows; `weight_of` has the weight of every term for the query."""
        size = self.start[rows + 1] - self.start[rows]
        at = np.arange(int(size.sum())) + np.repeat(self.start[rows] - np.cumsum(size) + size, size)
        total = np.concatenate([[0], np.cumsum(weight_of[self.term[at]] * self.impact[at])])
        end = np.cumsum(size)
        return total[end] - total[end - size]


class Best:
    """The k best of one query so far: highest score, then least id."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, floor)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, id: np.ndarray) -> None:
        good = score >= self.floor
        score, id = np.concatenate([self.score, score[good]]), np.concatenate([self.id, id[good]])
        order = np.lexsort((id, -score))[:self.k]
        self.score, self.id = score[order], id[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])  # a tie may still win by its id


def _chunks(batches: Iterator[pa.RecordBatch], n_docs: int, total: int, n_terms: int, bucket: int) -> Iterator[list[Bucket]]:
    """A task's vectors with any coordinate, in chunks, each as buckets from the longest to the shortest."""
    held, size = [], 0

    def cut() -> list[Bucket]:
        ids, n, count, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        impact = impacts(tf.astype(np.int64), np.repeat(n, count), n_docs, total)
        start = np.cumsum(count) - count
        length = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, start))
        order = np.argsort(-length, kind="stable")
        out = []
        for low in range(0, len(order), bucket):
            rows = order[low:low + bucket]
            own = count[rows]
            at = np.arange(int(own.sum())) + np.repeat(start[rows] - np.cumsum(own) + own, own)
            out.append(Bucket(ids[rows], np.concatenate([[0], np.cumsum(own)]), term[at], impact[at], length[rows], n_terms))
        return out

    for batch in batches:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        count = np.diff(batch.column(2).offsets.to_numpy())
        term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
        some = count > 0
        if some.any():
            held.append((ids[some], n[some], count[some], term, tf))
            size += len(term)
        if size >= CHUNK:
            yield cut()
            held, size = [], 0
    if held:
        yield cut()


def search(rows: DataFrame, queries: Queries, n_docs: int, total: int, n_terms: int, k: int, only_longest: bool, bucket: int = BUCKET) -> DataFrame:
    """(item, id, score): each task's k best for each item of the block, none below the item's floor.

    With `only_longest` a task looks at the first bucket of each of its chunks alone.
    """
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = [Best(k, floor) for floor in q.least.tolist()]
        norm = [math.sqrt(float((q.of(at)[1].astype(float) ** 2).sum())) for at in range(len(q.items))]
        weight_of = np.zeros(n_terms, np.int64)
        for buckets in _chunks(batches, n_docs, total, n_terms, bucket):
            for at, mine in enumerate(best):
                term, weight = q.of(at)
                if not len(term):
                    continue
                weight_of[term] = weight
                for b in buckets[:1] if only_longest else buckets:
                    if norm[at] * b.length[0] * (1 + 1e-9) + 1e-3 < mine.floor:
                        break  # nor can any shorter one
                    survivors = b.may_reach(term, weight, mine.floor)
                    if len(survivors):
                        mine.add(b.scores(survivors, weight_of), b.ids[survivors])
                weight_of[term] = 0
        for at, mine in enumerate(best):
            if len(mine.id):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine.id), at, np.int32)), pa.array(mine.id, pa.int64(), mask=mine.id == _NO_ID), pa.array(mine.score)],
                    names=["item", "id", "score"],
                )

    return rows.select("id", "n", "term", "tf").mapInArrow(work, "item int, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["item"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k)


def rank(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, ranked from 1.

    Equal scores by ascending id (integers), documents without an id last. Every row of `docs` is a document of its
    own. Rows of one item are one item with the terms of all; items without terms, or whose terms no document holds,
    have no rows. Null and empty texts have no terms. Items are asked in blocks, each against all documents, so only
    one block's terms are in memory and sent to the tasks; empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    kind = items.schema["item"].dataType.simpleString()
    out = None
    for block in range(blocks):
        asked: dict = {}
        for row in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toLocalIterator():
            asked.setdefault(row["item"], set()).update(terms_of(row["text"]))
        names = sorted(asked, key=lambda x: (x is None, x if x is not None else 0))
        vocabulary = sorted(set().union(*asked.values()))
        place = {t: n for n, t in enumerate(vocabulary)}
        folder = scratch(spark, "impact-vectors")
        vectors(docs, id, text, vocabulary).write.parquet(folder)
        made = spark.read.schema("id bigint, n bigint, term array<int>, tf array<int>").parquet(folder)
        n_docs, total = made.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = {r["t"]: r["n"] for r in made.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        weights = {t: term_weight(n_docs, df.get(n, 0)) for t, n in place.items()}
        lists = [sorted(((weights[t], place[t]) for t in asked[x] if place[t] in df), reverse=True) for x in names]
        flat = np.array([p for pairs in lists for p in pairs], np.int64).reshape(-1, 2)
        first = np.cumsum([0, *map(len, lists)])
        queries = Queries(names, first, flat[:, 1], flat[:, 0], np.zeros(len(names), np.int64))
        if total:
            seen = _best(search(made, queries, n_docs, total, len(vocabulary), k, True), k)
            for r in seen.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).collect():
                queries.least[r["item"]] = r["least"]
        found = _best(search(made if total else made.limit(0), queries, n_docs, max(total, 1), len(vocabulary), k, False), k)
        named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        found = found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out


RANK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d),
p AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM i JOIN f USING (term), s),
v AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN t USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM v WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

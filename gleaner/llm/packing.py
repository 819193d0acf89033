"""Packing into optimal length buckets.

The lengths of all sequences make one histogram; dynamic programming over it finds the bucket boundaries with the
least padding, where every sequence is padded to the boundary of its bucket. Inside a bucket, sequences in order of
their ids fill batches of one token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordering import global_rank

MAX_TOKENS = 4096  # longer texts are cut into pieces of this many tokens
BUCKETS = 12
BUDGET = 32_768  # tokens of a batch, padding included


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The boundaries that pad least, of `buckets` or fewer; ties take the smaller boundary. Exact integers."""
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(x):
        return []
    seqs, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    best = x * seqs[1:] - tokens[1:]  # one bucket up to each length
    came = [np.full(len(x), -1)]
    for _ in range(1, min(buckets, len(x))):
        more, where = best.copy(), np.full(len(x), -1)
        for j in range(1, len(x)):
            cost = best[:j] + x[j] * (seqs[j + 1] - seqs[1:j + 1]) - (tokens[j + 1] - tokens[1:j + 1])
            i = int(cost.argmin())
            if cost[i] < more[j]:
                more[j], where[j] = cost[i], i
        came.append(np.where(where < 0, -2, where))  # -2: fewer buckets do as well
        best = more
    cut, level, at = [], len(came) - 1, len(x) - 1
    while at >= 0:
        while level and came[level][at] == -2:
            level -= 1
        cut.append(int(x[at]))
        at = int(came[level][at]) if level else -1
        level -= 1
    return sorted(cut)


def sequences(docs: DataFrame, id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, piece, start, n_tokens): texts as runs of non-space characters, cut every `max_tokens` of them.

    A text without tokens, null ones included, is one piece of no tokens, so no row is lost.
    """
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = docs.select(F.col(id).alias("id"), n.alias("n"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / max_tokens).cast("int") - 1, F.lit(0)))
    rows = rows.select("id", "n", F.explode(pieces).alias("piece"))
    start = F.col("piece").cast("bigint") * max_tokens
    return rows.select("id", F.col("piece").cast("bigint").alias("piece"), start.alias("start"), F.least(F.col("n") - start, F.lit(max_tokens)).alias("n_tokens"))


def pack(rows: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """`rows` (id, piece, start, n_tokens) with bucket_len, batch (from 0 within the bucket), slot and padding.

    A batch holds as many sequences as fit `budget` tokens at the bucket's length, one at least; the last batch of a
    bucket may hold fewer. The order is (id, piece), null ids first; rows that repeat both stand in any order. The
    histogram that reaches the driver has one row per length, as many as `sequences` allows at most. Sequences of no
    tokens take no room and share the bucket of length 0. No rows give no rows.
    """
    counts = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["n_tokens"]: r["n"] for r in counts}
    some = {k: v for k, v in histogram.items() if k > 0}
    cut = boundaries(np.array(list(some), np.int64), np.array(list(some.values()), np.int64), buckets)
    edges = ([0] if 0 in histogram else []) + cut
    length = F.lit(None).cast("bigint")
    for edge in reversed(edges):
        length = F.when(F.col("n_tokens") <= edge, F.lit(edge).cast("bigint")).otherwise(length)
    held = rows.withColumn("bucket_len", length)
    ranked = global_rank(held, ["bucket_len"], [F.asc_nulls_first("id"), F.asc("piece")], "_place")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("bigint")
    at = F.col("_place") - 1
    return ranked.select(
        "id", "piece", "start", "n_tokens", "bucket_len", F.floor(at / room).cast("bigint").alias("batch"),
        (at % room).cast("bigint").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).cast("bigint").alias("padding"),
    )


def pack_sql(buckets: int = BUCKETS, budget: int = BUDGET, max_tokens: int = MAX_TOKENS) -> str:
    """The same result in DuckDB's SQL: the dynamic programme as one table per number of buckets."""
    tables = [f"""
d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
s AS (SELECT doc_id, p::BIGINT AS piece, (p * {max_tokens})::BIGINT AS start, least(n - p * {max_tokens}, {max_tokens})::BIGINT AS n_tokens
  FROM (SELECT *, unnest(range(greatest(ceil(n / {max_tokens})::INT, 1))) AS p FROM d)),
h AS MATERIALIZED (SELECT n_tokens AS x, count(*)::BIGINT AS c FROM s WHERE n_tokens > 0 GROUP BY 1),
q AS MATERIALIZED (SELECT x, sum(c) OVER (ORDER BY x)::BIGINT AS seqs, sum(c * x) OVER (ORDER BY x)::BIGINT AS tokens FROM h),
b1 AS MATERIALIZED (SELECT x, x * seqs - tokens AS cost, [x] AS cut FROM q)"""]
    for k in range(2, buckets + 1):
        tables.append(f"""
n{k} AS (SELECT j.x, min_by({{'cost': i.cost + j.x * (j.seqs - qi.seqs) - (j.tokens - qi.tokens), 'cut': list_append(i.cut, j.x)}},
  (i.cost + j.x * (j.seqs - qi.seqs) - (j.tokens - qi.tokens), i.x)) AS r FROM q j JOIN b{k - 1} i ON i.x < j.x JOIN q qi ON qi.x = i.x GROUP BY j.x),
b{k} AS MATERIALIZED (SELECT b.x, CASE WHEN r.cost < b.cost THEN r.cost ELSE b.cost END AS cost, CASE WHEN r.cost < b.cost THEN r.cut ELSE b.cut END AS cut
  FROM b{k - 1} b LEFT JOIN n{k} USING (x))""")
    return "WITH " + ",".join(tables) + f""",
e AS (SELECT unnest(cut) AS edge FROM (SELECT cut FROM b{buckets} ORDER BY x DESC LIMIT 1) UNION ALL SELECT DISTINCT 0 FROM s WHERE n_tokens = 0),
l AS (SELECT s.*, min(edge)::BIGINT AS bucket_len FROM s JOIN e ON edge >= n_tokens GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY doc_id, piece) - 1 AS at_, greatest(1, {budget} // greatest(bucket_len, 1)) AS room FROM l)
SELECT doc_id, piece, start, n_tokens, bucket_len, (at_ // room)::BIGINT AS batch, (at_ % room)::BIGINT AS slot, (bucket_len - n_tokens)::BIGINT AS padding FROM r"""

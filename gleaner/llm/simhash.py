"""SimHash near-dedup: fingerprints that differ in a few bits, found through tables of distances to references.

Each fingerprint's Hamming distances to reference fingerprints make its row of the pivot table. Two fingerprints
that differ in d bits differ by at most d in every coordinate, so pairs with a greater difference anywhere are
discarded, and the survivors are compared bit by bit.

Which pairs meet: fingerprints are cut into `bits + agree` segments, and a segment has references of its own (the
zero segment and each single bit). At most `bits` segments hold a difference, so at least `agree` segments have a
coordinate difference of 0 throughout. Those coordinates are the key under which fingerprints meet; they are
written as the segment's bits, which they determine and are determined by. Whole-fingerprint coordinates alone
exclude too little before pairs are formed: every reference splits uniform fingerprints about 0.57 to 0.43.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import components
from gleaner.llm.pairs import forest, pairs_in_runs, run_bounds
from gleaner.session import cut_lineage

BITS, SHINGLE, SEED = 4, 4, 42
REFERENCES = 24
BLOCK = 2048  # fingerprints of one key that are compared in one go
REFERENCE_POINTS = np.random.default_rng(64).integers(0, 1 << 64, REFERENCES, dtype=np.uint64, endpoint=False)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles of a text, as an unsigned number; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    n = max(1, len(words) - shingle + 1)
    last = end[shingle - 1:] if len(words) >= shingle else end[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        cut = slice(low, min(n, low + (1 << 16)))
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[:n][cut].tolist(), last[cut].tolist(), strict=True)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `fp`, the fingerprint as a signed long; null and empty texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], schema=batch.schema.append(pa.field("fp", pa.int64())))

    docs = docs.drop("fp") if text != "fp" else docs
    at = docs.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, fp bigint")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every reference, one row per reference."""
    return np.stack([np.bitwise_count(fps ^ r) for r in REFERENCE_POINTS]).astype(np.int8)


def close_pairs(fps: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of places (a, b): those no coordinate rules out and whose fingerprints differ in `bits` or fewer."""
    for row in table:
        near = np.abs(row[a] - row[b]) <= bits
        a, b = a[near], b[near]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
    return a[near], b[near]


def _keys(distinct: DataFrame, bits: int, agree: int) -> DataFrame:
    """(key, fp): each fingerprint under the agreement of any `agree` of its segments."""
    n = bits + agree
    edges = [64 * k // n for k in range(n + 1)]
    segments = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = [F.xxhash64(F.lit(k), *[segments[s] for s in chosen]) for k, chosen in enumerate(combinations(range(n), agree))]
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(distinct: DataFrame, bits: int = BITS, agree: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly what all links of at most `bits` differing bits connect.

    `distinct` (fp) holds each fingerprint once. A key that more than `block` fingerprints share is cut into blocks,
    and every two of them meet in a task; inside a task only a spanning forest of the links is given out.
    """
    if agree is None:  # so that uniform fingerprints of one key stay a few
        n = distinct.count()
        agree = next((r for r in (2, 3, 4) if n >> (64 * r // (bits + r)) < 64), 4)
    keyed = cut_lineage(_keys(distinct, bits, agree))
    count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = count.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = keyed.join(blocks, "key").withColumn("mine", mine)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    met = met.select(meeting.alias("meeting"), "fp").repartition("meeting").sortWithinPartitions("meeting")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from found(key[:whole], fp[:whole])
            rest_key, rest_fp = key[whole:], fp[whole:]
        yield from found(rest_key, rest_fp)

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pivot_table(fp)
        root = np.arange(len(fp))
        for a, b in pairs_in_runs(*run_bounds(key)):
            a, b = close_pairs(fp, a, b, bits, table)
            if len(a):
                root = forest(np.concatenate([a, np.arange(len(fp))]), np.concatenate([b, root]), len(fp))
        at = np.nonzero(root != np.arange(len(fp)))[0]
        if len(at):
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[at]), pa.array(signed[root[at]])], names=["a", "b"])

    return met.mapInArrow(compare, "a bigint, b bigint")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fp, component_id): the least id reachable over links of at most `bits` differing bits.

    Equal fingerprints are one node, so copies cost nothing; texts without words share fingerprint 0. Rows without
    an id join a component but never name it; a component without any id has component_id null. Rows that repeat an
    id are given out as often. An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text"))).select("id", "fp"))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")

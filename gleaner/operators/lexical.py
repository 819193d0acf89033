"""Scoring documents by how much of a query's wording they contain, weighted by rarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import broadcast_if_small, cut_lineage

QUERY, ITEM = "query", "id"


def document_grams(docs: DataFrame, script_map: dict[str, str] | None = None) -> DataFrame:
    """(id, gram), each once per document; documents without any text do not count."""
    read = docs.filter(F.length("text") > 0).select(ITEM, T.units(F.col("text"), script_map).alias("us"))
    return read.select(ITEM, F.explode(T.grams(F.col("us"))).alias("gram"))


def query_grams(queries: DataFrame, script_map: dict[str, str] | None = None) -> DataFrame:
    """(query, gram) a query asks for; a query with no unit asks for nothing."""
    read = queries.select(QUERY, T.units(F.col("text"), script_map).alias("us"))
    return read.select(QUERY, F.explode(T.wanted_grams(F.col("us"))).alias("gram"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length("text") > 0).agg(F.count(F.lit(1)).alias("n"))


def weigh(counts: DataFrame, size: DataFrame) -> DataFrame:
    """(gram, df, idf, unseen) from document counts; `size` is a single row."""
    return counts.crossJoin(F.broadcast(size)).select(
        "gram", "df",
        F.ln((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf"),
        F.ln((F.col("n") + 1) / F.lit(0.5)).alias("unseen"),
    )


def gram_weights(postings: DataFrame, size: DataFrame) -> DataFrame:
    """Weights of every gram present."""
    return weigh(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), size)


def build_lexical_index(docs: DataFrame, script_map: dict[str, str] | None = None) -> DataFrame:
    """Weights of all grams of the corpus."""
    return gram_weights(document_grams(docs, script_map), corpus_size(docs))


def write_postings(docs: DataFrame, table: str, buckets: int, script_map: dict[str, str] | None = None) -> None:
    """Postings as a bucketed table: a later probe on gram shuffles only its own side."""
    document_grams(docs, script_map).write.mode("overwrite").bucketBy(buckets, "gram").sortBy("gram").saveAsTable(table)


def score_postings(queries: DataFrame, postings: DataFrame, size: DataFrame, script_map: dict[str, str] | None = None) -> DataFrame:
    """Probe postings (id, gram) with the queries' grams.

    Only postings some query asks for are kept, once, and both the weights and the sums are worked out from
    them: texts are read a single time. The postings of a frequent gram are never brought together: they are
    counted map-side, and the wanted list is small enough for Spark to broadcast or, when it is not, the join
    is one whose skewed partitions adaptive execution splits.
    """
    wanted = query_grams(queries, script_map)
    hits = cut_lineage(postings.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    return score_hits(wanted, hits, gram_weights(hits, size), size)


def score_hits(wanted: DataFrame, hits: DataFrame, weights: DataFrame, size: DataFrame) -> DataFrame:
    """Shares of the documents in `hits`, the postings of wanted grams, by the given weights."""
    weighed = cut_lineage(wanted.join(weights.drop("unseen"), "gram", "left").crossJoin(F.broadcast(size)).select(
        QUERY, "gram", "idf", F.coalesce("idf", F.ln((F.col("n") + 1) / F.lit(0.5))).alias("ask")
    ))
    totals = weighed.groupBy(QUERY).agg(F.sum("ask").alias("total"))
    # broadcast when measured small: postings are then summed where they are, document by document
    known = broadcast_if_small(weighed.filter(F.col("idf").isNotNull()))
    found = hits.join(known, "gram").groupBy(QUERY, ITEM).agg(F.sum("idf").alias("found"))
    return found.join(broadcast_if_small(totals), QUERY).select(QUERY, ITEM, (F.col("found") / F.col("total")).alias("share"))


def lexical_score(queries: DataFrame, docs: DataFrame, script_map: dict[str, str] | None = None) -> DataFrame:
    """(query, id, share): 1.0 is all of the query's wording; documents with none of it are absent.

    Only grams that some query asks for leave the task that reads a text, unless the queries ask for too many.
    """
    wanted = cut_lineage(query_grams(queries, script_map))
    grams = [r["gram"] for r in wanted.select("gram").distinct().take(MAX_GRAMS + 1)]
    size = corpus_size(docs)
    if len(grams) > MAX_GRAMS:
        return score_postings(queries, document_grams(docs, script_map), size, script_map)
    hits = cut_lineage(held_grams(docs, grams, script_map))
    return score_hits(wanted, hits, gram_weights(hits, size), size)


MAX_GRAMS = 200_000  # looked up where texts are read
_SIGNS = 0x110000


@dataclass(frozen=True)
class _Wanted:
    """Some grams by the numbers of their units: `single` has the gram that is one unit, or -1; `pairs` the sorted
    numbers of two units (first * units + second) and `pair_grams` their grams. `signs` says what a unit by itself is."""

    units: pa.Array
    single: np.ndarray
    pairs: np.ndarray
    pair_grams: np.ndarray
    grams: pa.Array
    signs: np.ndarray


def _sign_table(spark: SparkSession) -> np.ndarray:
    """Whether a character is a unit by itself, as Spark's regular expressions have it."""
    signs = "".join(map(chr, [*range(0xD800), *range(0xE000, _SIGNS)]))
    kept = spark.range(1).select(F.regexp_replace(F.lit(signs), T.SIGN_PATTERN, "").alias("s")).first()["s"]
    table = np.zeros(_SIGNS, dtype=bool)
    table[np.frombuffer(kept.encode("utf-32-le"), dtype=np.uint32)] = True
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = False  # of words
    return table


def _wanted(spark: SparkSession, grams: list[str]) -> _Wanted:
    parts = [tuple(g.split(" ")) for g in grams]
    units = sorted({u for p in parts for u in p})
    number = {u: i for i, u in enumerate(units)}
    single = np.full(len(units), -1, dtype=np.int64)
    pairs = []
    for i, p in enumerate(parts):
        if len(p) == 1:
            single[number[p[0]]] = i
        else:
            pairs.append((number[p[0]] * len(units) + number[p[1]], i))
    both = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    names = pa.array([u.encode() for u in units], pa.large_binary())
    return _Wanted(names, single, both[:, 0], both[:, 1], pa.array(grams, pa.string()), _sign_table(spark))


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _units_of(data: np.ndarray, starts: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where units begin in the bytes of folded texts, and the units."""
    held = _WORD[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    edges = starts[:-1][starts[:-1] < len(data)]
    begins[edges] = held[edges]
    alone = signs[:128][data & 0x7F] & (data < 0x80)  # none in lower case, but what a script table gives may be
    held |= alone
    begins |= alone
    leads = np.flatnonzero(data >= 0xC0)
    if len(leads):
        padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
        lead = padded[leads]
        n = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.where(n == 2, 0x1F, np.where(n == 3, 0x0F, 0x07)).astype(np.uint32)
        for i in (1, 2, 3):
            code = np.where(n > i, (code << np.uint32(6)) | (padded[leads + i] & np.uint32(0x3F)), code)
        unit = signs[np.minimum(code, _SIGNS - 1)]
        leads, n = leads[unit], n[unit]
        begins[leads] = True
        for i in range(4):
            places = leads[n > i] + i
            held[places[places < len(data)]] = True
    places = np.flatnonzero(begins)
    kept = np.cumsum(held)
    offsets = np.append(kept[places] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[held]))]
    return places, pa.Array.from_buffers(pa.large_binary(), len(places), buffers)


def _grams_held(data: np.ndarray, starts: np.ndarray, wanted: _Wanted) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram), each once, of the wanted grams in folded texts."""
    places, units = _units_of(data, starts, wanted.signs)
    known = pc.fill_null(pc.index_in(units, value_set=wanted.units), -1).to_numpy().astype(np.int64)

    def row(of: np.ndarray) -> np.ndarray:
        return np.searchsorted(starts, places[of], side="right") - 1

    ones = np.flatnonzero(known >= 0)
    ones = ones[wanted.single[known[ones]] >= 0]
    rows, grams = [row(ones)], [wanted.single[known[ones]]]
    if len(wanted.pairs):
        two = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0))
        both = known[two] * len(wanted.units) + known[two + 1]
        at = np.minimum(np.searchsorted(wanted.pairs, both), len(wanted.pairs) - 1)
        asked = wanted.pairs[at] == both
        two, at = two[asked], at[asked]
        first = row(two)
        inside = first == row(two + 1)
        rows.append(first[inside])
        grams.append(wanted.pair_grams[at[inside]])
    once = np.unique(np.concatenate(rows) * len(wanted.grams) + np.concatenate(grams))
    return once // len(wanted.grams), once % len(wanted.grams)


def held_grams(docs: DataFrame, grams: list[str], script_map: dict[str, str] | None = None) -> DataFrame:
    """(id, gram) of `document_grams` for the given grams; texts are compared where they are read."""
    id_type = docs.schema[ITEM].dataType.simpleString()
    spark = docs.sparkSession
    if not grams:
        return spark.createDataFrame([], f"{ITEM} {id_type}, gram string")
    shared = spark.sparkContext.broadcast(_wanted(spark, grams))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            texts, ids = batch.column("text").cast(pa.large_binary()), batch.column(ITEM)
            _, starts = _binary(texts)
            first = 0
            while first < batch.num_rows:  # in parts of some megabytes, a text at least
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + _PART_BYTES, side="right")) - 1)
                rows, held = _grams_held(*_binary(texts.slice(first, last - first)), wanted)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows + first)), wanted.grams.take(pa.array(held))], names=[ITEM, "gram"])
                first = last

    read = docs.filter(F.length("text") > 0).select(ITEM, T.fold(F.col("text"), script_map).alias("text"))
    return read.mapInArrow(hold, f"{ITEM} {id_type}, gram string")


SEED_BYTES = (32, 16, 8, 4, 2, 1, 0)  # bytes that a text is first looked up by: as many as the passage has
_SLOT_BITS = 20  # a table of this many bits says which runs may be a seed: 1 MB however many passages there are
_FACTOR = 0x9E3779B97F4A7C15
_PART_BYTES = 8 << 20


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a column of long binaries, and where each value starts (and the last one ends)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and offsets[-1] else np.zeros(0, dtype=np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _run_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hash of the k bytes from each place on) for the wanted powers of two, each from the one half as long."""
    size, hashes, power = 1, data.astype(np.uint64) + np.uint64(1), _FACTOR
    while size <= max(sizes) and len(hashes):
        if size in sizes:
            yield size, (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:]
        size, power = 2 * size, power * power % (1 << 64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _seed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each `_seed`, all of whose bytes are one run."""
    for batch in batches:
        hashes = []
        for seed in batch.column("_seed").to_pylist():
            runs = _run_hashes(np.frombuffer(seed, dtype=np.uint8), (len(seed),)) if seed else ()
            hashes.append(next((int(h[0].astype(np.int64)) for _, h in runs), 0))
        kept = [c for c in batch.schema.names if c != "_seed"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(hashes, pa.int64())], names=[*kept, "_hash"])


def _seeds_held(data: np.ndarray, starts: np.ndarray, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, k, hash), each once, of the runs inside a row that may be a seed."""
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    if 0 in tables:
        rows = np.arange(len(starts) - 1)
        found.append((rows, np.zeros_like(rows), np.zeros_like(rows)))
    sizes = tuple(k for k in tables if k)
    for k, hashes in _run_hashes(data, sizes) if sizes else ():
        places = np.flatnonzero(tables[k][_slots(hashes)])
        rows = np.searchsorted(starts, places, side="right") - 1
        inside = places + k <= starts[rows + 1]
        once = np.unique(np.stack([rows[inside], hashes[places[inside]].astype(np.int64)]), axis=1)
        found.append((once[0], np.full(once.shape[1], k), once[1]))
    rows, ks, hashes = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], ks[order], hashes[order]


def _holders(docs: DataFrame, tables: dict[int, np.ndarray]) -> DataFrame:
    """(id, text, _n, _hash) of the documents with runs that may be a seed, a row for each of these."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            _, starts = _binary(texts)
            first = 0
            while first < batch.num_rows:  # in parts of some megabytes, a text at least
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + _PART_BYTES, side="right")) - 1)
                rows, ks, hashes = _seeds_held(*_binary(texts.slice(first, last - first)), shared.value)
                some, at = np.unique(rows, return_index=True)
                if len(some):
                    cuts = pa.array(np.append(at, len(rows)), pa.int32())
                    seeds = pa.StructArray.from_arrays([pa.array(ks, pa.int64()), pa.array(hashes, pa.int64())], names=["_n", "_hash"])
                    held = batch.take(pa.array(some + first))
                    yield pa.RecordBatch.from_arrays(
                        [held.column(ITEM), held.column("text"), pa.ListArray.from_arrays(cuts, seeds)], names=[ITEM, "text", "_seeds"])
                first = last

    id_type = docs.schema[ITEM].dataType.simpleString()
    held = docs.select(ITEM, "text").mapInArrow(hold, f"{ITEM} {id_type}, text string, _seeds array<struct<_n: bigint, _hash: bigint>>")
    return held.select(ITEM, "text", F.inline("_seeds"))


def verbatim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, id) of the documents that hold a query's text as it stands.

    Whatever holds a passage holds the bytes in its middle, so these are looked up, by their hash, among the runs of
    equal length of all documents where the texts are read, and only what has them is searched for the whole passage.
    """
    n = F.octet_length("text")
    length = F.coalesce(*[F.when(n >= k, k) for k in SEED_BYTES]).cast("bigint")
    passages = queries.filter(F.col("text").isNotNull()).select(QUERY, F.col("text").alias("_q"), length.alias("_n"), n.alias("_len"))
    middle = F.expr("substring(cast(_q AS binary), cast((_len - _n) div 2 + 1 AS int), cast(_n AS int))")
    query_type = queries.schema[QUERY].dataType.simpleString()
    passages = cut_lineage(passages.select(QUERY, "_q", "_n", middle.alias("_seed")).mapInArrow(
        _seed_hashes, f"{QUERY} {query_type}, _q string, _n bigint, _hash bigint"))
    slot = F.shiftrightunsigned("_hash", 64 - _SLOT_BITS)
    tables = {}
    for row in passages.select("_n", slot.alias("slot")).distinct().collect():  # as many as the tables have bits at most
        tables.setdefault(row["_n"], np.zeros(1 << _SLOT_BITS, dtype=bool))[row["slot"]] = True
    if not tables:
        return queries.select(QUERY).crossJoin(docs.select(ITEM)).limit(0)
    held = _holders(docs.filter(F.col(ITEM).isNotNull() & F.col("text").isNotNull()), tables)
    found = held.join(broadcast_if_small(passages), ["_n", "_hash"])
    return found.filter(F.contains("text", F.col("_q"))).select(QUERY, ITEM)

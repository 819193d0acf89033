"""Line dedup: two Bloom filters say which lines may repeat; only those are shuffled and confirmed.

One pass fills a filter of lines seen once and one of lines seen twice, in parts that are merged by place; a line two
parts have seen is set in both parts' first filter, so it comes to stand in the second. The second filter goes to
all tasks: its size follows the number of lines up to `max_bits`, beyond which more lines are suspected, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, ascii_lower
from gleaner.session import cut_lineage

MIN_LENGTH, MIN_DOCS = 20, 3
MAX_BITS = 1 << 30  # 128 MB, what a task holds of the second filter at most
SEGMENT = 1 << 16  # bytes of a filter that travel as one row
_PROBES = 3
_STRIP = SPACES.encode()


def line_keys(text: bytes, min_length: int = MIN_LENGTH) -> set[bytes]:
    """The distinct keys of a text's lines that are long enough, in code points."""
    found = set()
    for line in text.lower().split(b"\n"):  # bytes: only A-Z change
        key = line.strip(_STRIP)
        if len(key) >= min_length and (len(key) >= 4 * min_length or len(key.decode()) >= min_length):
            found.add(key)
    return found


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash, one row per probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(_PROBES)])


def _held(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _put(filter_: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (places >> np.uint64(3)).ravel(), (np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)).ravel())


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def repeat_filter(docs: DataFrame, text: str, bits: int, min_length: int = MIN_LENGTH) -> np.ndarray:
    """The filter of lines that two rows may share; `bits` is a power of two."""
    segment = min(SEGMENT, bits // 8)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = [k for t in _texts(batch.column(0)) for k in line_keys(t, min_length)]
            hashes, n = np.unique(_hashes(keys), return_counts=True)
            places = _probes(hashes, bits)
            _put(twice, places[:, (n > 1) | _held(once, places)])
            _put(once, places)
        yield from _segments(once, twice)

    def _segments(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.nonzero(once.reshape(-1, segment).any(axis=1))[0]:
            part = slice(k * segment, (k + 1) * segment)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([once[part].tobytes()]), pa.array([twice[part].tobytes()])], names=["segment", "once", "twice"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                once, twice = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if k in held:
                    before = held[k]
                    held[k] = [before[0] | once, before[1] | twice | (before[0] & once)]
                else:
                    held[k] = [once, twice]
        for k, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([twice.tobytes()])], names=["segment", "twice"])

    parts = docs.select(F.col(text)).mapInArrow(fill, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(merge, "segment int, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # never more than `bits`
        whole[row["segment"] * segment:(row["segment"] + 1) * segment] = np.frombuffer(row["twice"], np.uint8)
    return whole


def suspects(docs: DataFrame, id: str, text: str, twice: np.ndarray, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, key): the lines the second filter holds, once per row."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    kind = docs.schema[id].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys = [], []
            for at, t in enumerate(_texts(batch.column(1))):
                mine = line_keys(t, min_length)
                row += [at] * len(mine)
                keys += mine
            hit = np.nonzero(_held(shared.value, _probes(_hashes(keys), 8 * len(shared.value))))[0] if keys else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([row[k] for k in hit], pa.int64())), pa.array([keys[k].decode() for k in hit], pa.string())],
                names=["id", "key"],
            )

    return docs.select(F.col(id).alias("id"), F.col(text)).filter(F.col("id").isNotNull()).mapInArrow(probe, f"id {kind}, key string")


def line_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """`docs` with the lines of `text` dropped that at least `min_docs` documents hold, but for those of the greatest
    id holding each, and n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; shorter keys than `min_length` code
    points stay. Rows of one id are one document. Rows without an id neither count nor lose lines. A null text is one
    empty line. A document that loses all its lines has the empty text. An empty table gives no rows.
    Columns named n_lines and n_dropped are replaced.
    """
    breaks = F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = docs.agg(F.sum(breaks + 1).alias("n")).first()["n"] or 0
    bits = 1 << max(10, min(max_bits.bit_length() - 1, int(16 * n_lines).bit_length()))
    twice = repeat_filter(docs, text, bits, min_length)
    suspected = cut_lineage(suspects(docs, id, text, twice, min_length))
    found = suspected.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
    # written, so that the join reads two plain shuffles and a line of very many documents is split between tasks
    found = cut_lineage(found.filter(F.col("n") >= min_docs).select("key", "last"))
    lost = suspected.join(found, "key").filter(F.col("id") != F.col("last"))
    lost = lost.groupBy("id").agg(F.collect_set("key").alias("_drop")).select(F.col("id").alias("_id"), "_drop")
    rows = docs.drop(*[c for c in ("_id", "_drop", "n_lines", "n_dropped") if c not in (id, text)])
    rows = rows.join(lost, rows[id] == lost["_id"], "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def stays(line):
        return ~F.array_contains("_drop", F.btrim(ascii_lower(line), F.lit(SPACES)))

    rows = rows.withColumn("_lines", lines).withColumn(
        "_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", stays))
    )
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped", "_id", "_drop")]
    return rows.select(
        *others, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n")).alias(text),
        F.size("_lines").cast("bigint").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_dropped"),
    )


LINE_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

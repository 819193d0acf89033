"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions alone.

A shingle is five words in a row, its hash the first 64 bits of MD5 in hex, and a text's sketch its k least distinct
hashes in ascending order. Sketches of parts merge into the sketch of the whole, and two sketches tell how alike
their texts are, how much of one the other contains, and how many distinct shingles a text has.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower
from gleaner.session import cut_lineage, take_bounded

K, SHINGLE = 128, 5
RANGE_BYTES = 4 << 20  # of text that one range of the order holds, as long as MAX_RANGES allow
MAX_RANGES = 1 << 16  # keys of 16 bytes that are collected and sent to the tasks
_HEX = 13  # hex digits a double takes whole


def normal_text(text: Column) -> Column:
    """The words of a text, that is its runs of anything but ASCII white space, with single spaces and A-Z lower-cased."""
    return F.btrim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "), F.lit(" "))


def shingles_of(normal: Column, size: int = SHINGLE) -> Column:
    """Every run of `size` words, once for each place; fewer words than that are one shingle, no words give none."""
    run = rf"(?:^| )(?=((?:[^ ]++ ){{{size - 1}}}[^ ]++))"  # looks ahead from before each word
    found = F.regexp_extract_all(normal, F.lit(run), F.lit(1))
    return F.when(normal == "", F.lit([]).cast("array<string>")).when(F.size(found) == 0, F.array(normal)).otherwise(found)


def sketch_of(shingles: Column, k: int = K) -> Column:
    """The k least distinct hashes, of which the first 64 bits are kept."""
    least = F.slice(F.sort_array(F.array_distinct(F.transform(shingles, F.md5))), 1, k)
    return F.transform(least, lambda h: F.substring(h, 1, 16))


def with_sketch(rows: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """`rows` with the sketch of the whole text as `out`."""
    rows = rows.withColumn("_normal", normal_text(F.col(text))).withColumn("_shingles", shingles_of(F.col("_normal"), shingle))
    return rows.withColumn(out, sketch_of(F.col("_shingles"), k)).drop("_normal", "_shingles")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of both texts that both hold, 0 to 1; exact up to k shingles. Two texts
    without words are alike (1)."""
    both = F.array_intersect(a, b)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return (
        F.when(F.size(union) == 0, 1.0).when(F.size(both) == 0, 0.0)
        .otherwise(F.size(F.array_intersect(union, both)) / F.size(union))
    )


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    share = F.conv(F.substring(F.element_at(sketch, -1), 1, _HEX), 16, 10).cast("double") / float(16**_HEX)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of `a`'s text that `b`'s text holds too, 0 to 1; a text without words is
    contained in any."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    found = resemblance(a, b, k) * distinct_shingles(union, k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(found, F.lit(1.0)))


def merge(rows: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """(keys, sketch): the sketch of all texts of each group together.

    Hashes are made distinct before they are ranked and each task keeps k of a group, so no group meets in one task.
    """
    values = rows.select(*keys, F.explode_outer(sketch).alias("_h")).distinct()
    least = Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last())
    values = values.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k)
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))  # k hashes at most


def _range_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the `n` ascending bounds are less than the key, by halving steps."""
    steps = F.lit([1 << p for p in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.get(bounds, low + step - 1) < key), low + step).otherwise(low),
    )


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): every row beside the next one by descending id; after the last
    comes the first.

    Rows of one id are ordered by a hash of their text, rows without an id come last. Null texts are empty. One row
    is its own next. The order is cut into ranges of keys (id, hash), so a key of many rows is split by its texts;
    each range gets a copy of the row that follows it, and only then texts are shuffled, once.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.struct("id", F.xxhash64("text").alias("h")))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = max(1, min(MAX_RANGES, -(-size // range_bytes)))
    ordered = rows.select("_key").repartitionByRange(wanted, "_key")
    ends = take_bounded(cut_lineage(ordered.groupBy(F.spark_partition_id()).agg(F.max("_key").alias("end"))), MAX_RANGES, "ranges")
    ends = sorted((r["end"] for r in ends), key=lambda e: (e["id"] is not None, e["id"] if e["id"] is not None else 0, e["h"]))
    n = len(ends)
    kind = rows.schema["_key"].dataType.simpleString()
    listed = json.dumps([{"id": e["id"], "h": e["h"]} for e in ends])
    bounds = F.from_json(F.lit(listed), f"array<{kind}>")
    # the greatest key of a range follows the range above it, the greatest of all follows the last
    rows = rows.withColumn("_range", _range_of(F.col("_key"), bounds, n))
    heads = rows.filter(F.col("_key") == F.get(bounds, F.col("_range"))).dropDuplicates(["_range"])
    heads = heads.withColumn("_range", F.pmod(F.col("_range") + 1, F.lit(max(n, 1))))
    every = rows.withColumn("_copy", F.lit(False)).unionByName(heads.withColumn("_copy", F.lit(True)))
    order = [F.col("_copy").asc(), F.col("_key").desc()]
    every = every.repartition("_range").sortWithinPartitions("_range", *order)
    every = with_sketch(every, "text", "sketch", k)
    following = F.lead(F.struct("text", "sketch")).over(Window.partitionBy("_range").orderBy(*order))
    every = every.withColumn("_next", following).filter(~F.col("_copy"))
    return every.select("id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))


def edited(rows: DataFrame, k: int = K) -> DataFrame:
    """`with_next`'s rows with n_chars, the edited text (the last half of the text replaced by as much of the next
    text's beginning, or all of it) and its sketch. Lengths are in code points."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    return with_sketch(rows, "edited", "edited_sketch", k)


FINGERPRINT_SQL = rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM o),
e AS (SELECT doc_id, length(text) AS n_chars, text, following,
  substring(text, 1, length(text) - length(text) // 2) || substring(following, 1, length(text) // 2) AS edited FROM n),
t AS (SELECT DISTINCT x AS text FROM (SELECT text AS x FROM e UNION ALL SELECT edited FROM e)),
w AS (SELECT text, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT text, CASE WHEN len(w) = 0 THEN [] ELSE list_transform(list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1),
  lambda i: md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')))))[1:{K}], lambda h: substr(h, 1, 16)) END AS s FROM w),
j AS (SELECT e.*, a.s AS a, b.s AS b, c.s AS c FROM e JOIN s a ON a.text = e.text JOIN s b ON b.text = e.edited JOIN s c ON c.text = e.following),
u AS (SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:{K}] AS ab, list_sort(list_distinct(list_concat(a, c)))[1:{K}] AS ac FROM j)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
CASE WHEN len(ab) = 0 THEN 1.0 ELSE len(list_filter(ab, lambda x: list_contains(a, x) AND list_contains(b, x))) / len(ab) END::DOUBLE AS near_edited,
CASE WHEN len(ac) = 0 THEN 1.0 ELSE len(list_filter(ac, lambda x: list_contains(a, x) AND list_contains(c, x))) / len(ac) END::DOUBLE AS near_next FROM u"""

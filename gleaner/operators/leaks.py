"""Identifying words of a deny list found in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import broadcast_if_small

# Words too ordinary to identify anyone, and where a configured value is cut.
GENERIC = ("private", "memes", "data", "path", "work", "home", "users", "code", "desktop")
SEPARATORS = "[\\\\/:\\-_.\\s\\p{Z}]+"
WORD = "[0-9A-Za-z]+"
_EDGE = "[^0-9a-z]"


def denylist_parts(values: DataFrame, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """(part): identifying pieces of `value`: six characters, or four with a digit."""
    parts = values.select(F.explode(F.split("value", SEPARATORS)).alias("part")).distinct()
    size = F.length("part")
    long_enough = (size >= 6) | ((size >= 4) & F.col("part").rlike("\\p{Nd}"))
    return parts.filter(long_enough & ~F.lower("part").isin(*generic))


def scan_leaks(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part): whole-word matches, case ignored.

    A part is found through its first run of letters and digits, which must stand in the text as a word of its
    own; a part that is more than that run is then compared with the text.
    """
    keyed = parts.select(
        "part", F.lower("part").alias("_low"), F.lower(F.regexp_extract("part", WORD, 0)).alias("_word")
    )
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower))
    spoken = texts.select("id", F.explode(words).alias("_word"))
    met = spoken.join(keyed.filter("_word <> ''"), "_word")
    plain = met.filter(F.col("_low") == F.col("_word")).select("id", "part")
    longer = met.filter(F.col("_low") != F.col("_word")).select("id", "part", "_low")
    bare = keyed.filter("_word = ''").select("part", "_low")  # no Latin letter or digit at all
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    whole_word = F.concat(F.lit(_EDGE + "\\Q"), F.col("_low"), F.lit("\\E" + _EDGE))
    checked = longer.join(texts, "id").filter(F.rlike(padded, whole_word)).select("id", "part")
    loose = texts.join(broadcast_if_small(bare), F.contains(padded, F.col("_low")))
    loose = loose.filter(F.rlike(padded, whole_word)).select("id", "part")
    return reduce(DataFrame.unionByName, [plain, checked, loose])


def leak_report(found: DataFrame) -> DataFrame:
    """(id, parts) with the parts of each text in order; a text holds at most the deny list."""
    return found.groupBy("id").agg(F.array_sort(F.collect_set("part")).alias("parts"))

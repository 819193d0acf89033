"""Captions worth keeping of each template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.operators.ordering import top_k

# What a usable caption is.
BOXES, SHORTEST, LONGEST = 2, 10, 120
PRINTABLE = "^[\\x20-\\x7E]+$"


def pick_captions(entries: DataFrame, n: int = 3) -> DataFrame:
    """Two filled boxes, printable ASCII, no link; the `n` with most votes per template, ties by url."""
    boxes = F.coalesce("boxes", F.array().cast("array<string>"))
    caption = F.array_join(F.transform(boxes, strip), " / ")
    votes = F.coalesce(F.regexp_replace("votes", ",", "").try_cast("bigint"), F.lit(0))
    read = entries.select("*", caption.alias("caption"), votes.alias("_votes"))
    size = F.length("caption")
    good = (
        (F.size(boxes) == BOXES) & F.forall(boxes, lambda b: strip(b) != "") & size.between(SHORTEST, LONGEST)
        & ~F.contains(F.lower("caption"), F.lit("http")) & F.col("caption").rlike(PRINTABLE)
    )
    return top_k(read.filter(good), ["template"], [F.desc("_votes"), F.asc("url")], n).drop("_votes")

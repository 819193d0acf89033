"""Text expressions. One fold is used everywhere, so a query and a document are always read alike."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as one unit of wording, and as a character of a word.
UNIT_PATTERN = r"[a-z0-9]+|[\p{L}\p{Nl}\p{No}]"
SIGN_PATTERN = r"[^\p{L}\p{Nl}\p{No}]"  # what is no unit by itself
NON_WORD_PATTERN = r"[^\p{L}\p{N}]+"
SLOT_PATTERN = r"[\{\[【［][\s\p{Z}]*[XYZxyz][\s\p{Z}]*[\}\]】］]|(?<![A-Za-z])[XYZ](?![A-Za-z])"
SLOT_MARK = "{S}"

_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_LATIN = range(0x00C0, 0x0250)
_CALM_SPANS = "\\x00-\\x7f\\x{3001}-\\x{3029}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{4e00}-\\x{9fff}"


def _settled() -> str:
    """A text no compatibility normalisation changes: a few calm spans, and most Latin letters.

    One run of one class: looking for what is not in it takes ten times as long.
    """
    calm = [c for c in _LATIN if unicodedata.normalize("NFKC", chr(c)) == chr(c)]
    first, last = [c for c in calm if c - 1 not in calm], [c for c in calm if c + 1 not in calm]
    letters = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True))
    return f"\\A[{_CALM_SPANS}{letters}]*\\z"


SETTLED_PATTERN = _settled()


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility normalisation; only rows that may change are sent to Python."""
    unsettled = (F.octet_length(text) > F.length(text)) & ~text.rlike(SETTLED_PATTERN)
    return F.coalesce(_nfkc(F.when(unsettled, text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{_SPACE}+", " "))


def dense_length(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(text, f"{_SPACE}+", ""))


def fold_script(text: Column, script_map: dict[str, str] | None) -> Column:
    """One script variant for another, character by character, from the caller's table."""
    if not script_map:
        return text
    return F.translate(text, "".join(script_map), "".join(script_map.values()))


def fold(text: Column, script_map: dict[str, str] | None = None) -> Column:
    return fold_script(F.lower(nfkc(text)), script_map)


def units(text: Column, script_map: dict[str, str] | None = None) -> Column:
    return F.regexp_extract_all(fold(text, script_map), F.lit(UNIT_PATTERN), F.lit(0))


def pairs(us: Column) -> Column:
    """Adjacent units joined by a blank: no unit holds a blank, so a pair never equals a unit."""
    n = F.size(us)
    heads = F.slice(us, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(us, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 1, F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.array().cast("array<string>")
    )


def grams(us: Column) -> Column:
    """All units and pairs of a document, each once."""
    return F.array_distinct(F.concat(us, pairs(us)))


def wanted_grams(us: Column) -> Column:
    """What a query asks for: its one unit, or its pairs, each once."""
    return F.when(F.size(us) == 1, us).otherwise(F.array_distinct(pairs(us)))


def norm(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, NON_WORD_PATTERN, ""))


def bigrams(text: Column) -> Column:
    """Character bigrams with repeats; a single character stands for itself."""
    n = F.length(text)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n == 1, F.array(text))
        .otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))
    )


def quote_overlap(q: Column, t: Column) -> Column:
    """Share of the query's character bigrams found in the text (1.0 = copied wording).

    Both sides are columns already passed through `norm`; the text is looked at once per bigram.
    """
    parts = bigrams(q)
    found = F.size(F.filter(parts, lambda g: F.contains(t, g)))
    return F.when((F.length(q) == 0) | (F.length(t) == 0), F.lit(0.0)).otherwise(
        found / F.greatest(F.size(parts), F.lit(1))
    )


def normalize_pattern(text: Column) -> Column:
    """Wording around slot markers, comparable as a key."""
    parts = F.split(text, SLOT_PATTERN, -1)
    return F.array_join(F.transform(parts, norm), SLOT_MARK)

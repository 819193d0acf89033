"""Licence scan: a positional index of the rare words of licence phrases, in DataFrame functions alone.

Every phrase is indexed by its two words of highest IDF and their offsets. The positions of those words in a text,
less the offsets, must agree on a start (an intersection of shifted postings); the words there are then compared
with the whole phrase. A template's label needs all its mandatory phrases.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """`label` is given to a text that holds every phrase. Places of `base` templates are counted."""

    label: str
    phrases: tuple[str, ...]
    base: bool = False


# The four base phrases, then phrases that the public texts of the licences must hold.
TEMPLATES = (
    Template("gpl", ("gnu general public license",), base=True),
    Template("apache", ("apache license",), base=True),
    Template("cc-by", ("cc by",), base=True),
    Template("mit", ("mit license",), base=True),
    Template("agpl", ("gnu affero general public license",)),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("gpl-3", ("gnu general public license version 3",)),
    Template("gpl-2", ("gnu general public license version 2",)),
    Template("apache-2.0", ("apache license version 2 0",)),
    Template("cc-by-nc", ("cc by nc",)),
    Template("cc-by-sa", ("cc by sa",)),
    Template("cc-by-nd", ("cc by nd",)),
    Template("cc-by", ("creative commons attribution",)),
    Template("cc0", ("cc0 1 0 universal",)),
    Template("mpl", ("mozilla public license",)),
    Template("epl", ("eclipse public license",)),
    Template("bsl", ("boost software license",)),
    Template("unlicense", ("free and unencumbered software released into the public domain",)),
    Template("mit", ("permission is hereby granted free of charge to any person obtaining a copy",
                     "the above copyright notice and this permission notice shall be included in all copies")),
    Template("isc", ("permission to use copy modify and or distribute this software for any purpose",
                     "provided that the above copyright notice and this permission notice appear in all copies")),
    Template("bsd", ("redistribution and use in source and binary forms with or without modification are permitted",
                     "redistributions of source code must retain the above copyright notice")),
)


def words_of(text: Column) -> Column:
    """The words of a whole text, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def document_frequency(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How many of all documents hold each word of the templates: as many counts at most as the templates have words."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), F.lit(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _anchors(phrase: list[str], df: dict[str, int]) -> list[tuple[str, int]]:
    """The two words of highest IDF of a phrase, with their first offsets."""
    rare = sorted(dict.fromkeys(phrase), key=lambda w: (df.get(w, 0), -len(w), w))
    return [(w, phrase.index(w)) for w in rare[:2]]


def _starts(phrase: list[str], anchors: list[tuple[str, int]]) -> Column:
    """Where the phrase stands: shifted postings intersected, then all its words compared."""

    def posting(word: str, offset: int) -> Column:
        return F.transform(F.filter("_hits", lambda h: h["w"] == word), lambda h: h["i"] - offset)

    found = reduce(F.array_intersect, [posting(w, o) for w, o in anchors])
    here = F.lit(phrase)
    return F.filter(found, lambda s: (s >= 0) & (F.slice("_words", F.greatest(s, F.lit(0)) + 1, len(phrase)) == here))


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score, and `places`: an array of
    (label, phrase, start) of every phrase found, base or not.

    A null or empty text has no words, no labels (empty strings) and score 0; first_word and last_word are null
    where no base phrase stands. Rows are judged one by one, so repeated rows and ids do not matter, and an empty
    table gives an empty result. The score is the largest share of a template's phrases that the text holds.
    Columns of `docs` with a result's name are replaced.
    """
    made = ("_words", "_hits", "_found", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    phrases = list(dict.fromkeys(p for t in templates for p in t.phrases))
    split = {p: p.split(" ") for p in phrases}
    df = document_frequency(docs, text, sorted({w for p in split.values() for w in p}))
    anchors = {p: _anchors(split[p], df) for p in phrases}
    rare = sorted({w for a in anchors.values() for w, _ in a})
    rows = docs.drop(*[c for c in made if c != text]) if text not in made else docs
    rows = rows.withColumn("_words", words_of(F.col(text)))
    hit = F.transform("_words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("_hits", F.filter(hit, lambda h: h.isNotNull()))
    none = F.lit([]).cast("array<int>")
    some = F.size("_hits") > 0
    rows = rows.withColumn(
        "_found", F.struct(*[F.when(some, _starts(split[p], anchors[p])).otherwise(none).alias(f"p{k}") for k, p in enumerate(phrases)])
    )
    starts = {p: F.col(f"_found.p{k}") for k, p in enumerate(phrases)}
    base = F.concat(*[starts[p] for t in templates if t.base for p in t.phrases])

    def joined(chosen: list[Template]) -> Column:
        held = [F.when(reduce(lambda a, b: a & b, [F.size(starts[p]) > 0 for p in t.phrases]), F.lit(t.label)) for t in chosen]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))), ",")

    share = [reduce(lambda a, b: a + b, [(F.size(starts[p]) > 0).cast("double") for p in t.phrases]) / len(t.phrases) for t in templates]

    def listed(label: str, phrase: str) -> Column:
        return F.transform(starts[phrase], lambda s: F.struct(F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), s.cast("bigint").alias("start")))

    places = F.flatten(F.array(*[listed(t.label, p) for t in templates for p in t.phrases]))
    return rows.select(
        *[c for c in rows.columns if c not in ("_words", "_hits", "_found")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).cast("bigint").alias("first_word"),
        F.array_max(base).cast("bigint").alias("last_word"),
        joined([t for t in templates if t.base]).alias("base_labels"),
        joined(list(templates)).alias("labels"),
        F.greatest(*share).alias("score"),
        places.alias("places"),
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same result in DuckDB's SQL, for the tests: every position of every text is compared with every phrase."""
    phrases = list(dict.fromkeys(p for t in templates for p in t.phrases))

    def at(p: str) -> str:
        parts = p.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(parts))
        return f"list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: {same})"

    cols = ", ".join(f"{at(p)} AS p{k}" for k, p in enumerate(phrases))
    has = {p: f"(len(p{k}) > 0)" for k, p in enumerate(phrases)}
    whole = [(t, " AND ".join(has[p] for p in t.phrases)) for t in templates]

    def labels(chosen) -> str:
        held = ", ".join(f"CASE WHEN {cond} THEN '{t.label}' END" for t, cond in chosen)
        return f"coalesce(array_to_string(list_sort(list_distinct([{held}])), ','), '')"

    shares = ", ".join(f"({' + '.join(f'{has[p]}::INT' for p in t.phrases)}) / {len(t.phrases)}.0::DOUBLE" for t in templates)
    base = "flatten([" + ", ".join(f"p{phrases.index(p)}" for t in templates if t.base for p in t.phrases) + "])"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '{WORD}') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n, {cols} FROM d),
g AS (SELECT *, {base} AS b FROM f)
SELECT doc_id, n::BIGINT AS n_words, len(b)::BIGINT AS n_base, (list_min(b) - 1)::BIGINT AS first_word, (list_max(b) - 1)::BIGINT AS last_word,
{labels([x for x in whole if x[0].base])} AS base_labels, {labels(whole)} AS labels, greatest({shares})::DOUBLE AS score FROM g"""

"""A document's own words: lines common to several documents, furniture and noise go, wrapped lines are joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import noise as N
from gleaner.functions.text import norm, strip
from gleaner.operators.joins import lookup_join

COMMON_IN = 3  # a line on this many documents is a watermark

BOX = "array<array<double>>"
LINES = f"array<struct<text:string,box:{BOX},score:double>>"


def plain_lines(text: Column) -> Column:
    """Lines of a text that has no layout: no boxes, full confidence."""
    return F.transform(
        F.split(text, "\n"),
        lambda s: F.struct(s.alias("text"), F.array().cast(BOX).alias("box"), F.lit(1.0).alias("score")),
    )


def document_norms(docs: DataFrame) -> DataFrame:
    """(id, norm): the distinct normalised lines of each document, two characters or more."""
    norms = F.array_distinct(F.transform("lines", lambda x: norm(x["text"])))
    return docs.select("id", F.explode(norms).alias("norm")).filter(F.length("norm") >= 2)


def common_lines(docs: DataFrame, at_least: int = COMMON_IN) -> DataFrame:
    """(norm, n_docs) of lines found in `at_least` documents; counted map-side first."""
    counted = document_norms(docs).groupBy("norm").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.filter(F.col("n_docs") >= at_least)


def common_per_document(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(id, common): which of its lines each document shares; only ids and line keys are shuffled."""
    flagged = lookup_join(document_norms(docs), common.select("norm", "n_docs"), "norm", "n_docs", [F.col("id")])
    return flagged.filter(F.col("n_docs").isNotNull()).groupBy("id").agg(F.collect_set("norm").alias("common"))


def _edge(box: Column, axis: int, largest: bool) -> Column:
    values = F.transform(box, lambda p: p[axis])
    return F.coalesce(F.array_max(values) if largest else F.array_min(values), F.lit(0.0))


def _read(line: Column) -> Column:
    """A line with its place and its normal form."""
    t = strip(line["text"])
    return F.struct(
        t.alias("text"), norm(line["text"]).alias("norm"),
        _edge(line["box"], 0, False).alias("left"), _edge(line["box"], 1, False).alias("top"),
        _edge(line["box"], 0, True).alias("right"), _edge(line["box"], 1, True).alias("bottom"),
        line["score"].alias("score"),
    )


def _judge(x: Column) -> Column:
    """The line with what its text says about it; each pattern is looked at once."""
    t = x["text"]
    return F.struct(
        *[x[f].alias(f) for f in ("text", "norm", "left", "top", "right", "bottom")],
        t.startswith("@").alias("handle"), (N.is_account(t) | N.is_chrome(t)).alias("chrome"),
        N.is_account_id(t).alias("account"), N.is_furniture(t, x["norm"], x["score"]).alias("furniture"),
    )


def _height(x: Column) -> Column:
    return x["bottom"] - x["top"]


def _near(a: Column, b: Column) -> Column:
    """b right below a, or on the same row."""
    return (b["top"] - a["bottom"]) < F.greatest(_height(a), _height(b))


def _near_either(a: Column, b: Column) -> Column:
    return F.when(a["top"] <= b["top"], _near(a, b)).otherwise(_near(b, a))


def _is_name(name: Column, handle: Column) -> Column:
    """The line above an account that gives its display name."""
    size = F.length(name["text"])
    last = F.substring(name["text"], -1, 1)
    latin = ~N.has_cjk(name["text"]) & (size <= 40)
    short = handle & (size <= 12) & ~F.contains(F.lit(N.NAME_ENDS), last)
    return latin | short


def _context_drop(lines: Column, x: Column, i: Column) -> Column:
    above, below = F.get(lines, i - 1), F.get(lines, i + 1)
    name = (below["handle"] | below["chrome"]) & _near(x, below) & _is_name(x, below["handle"])
    bit = (F.length(x["norm"]) <= 3) & (
        (below["account"] & _near_either(x, below)) | (above["account"] & _near_either(above, x))
    )
    return F.coalesce(name, F.lit(False)) | F.coalesce(bit, F.lit(False))


_BOX = "struct<left:double,top:double,right:double,bottom:double>"
_BLOCK = 256  # marks are gathered in blocks, so that a document costs about as much as it has lines
_DROPPED, _STARTS, _RUNS_ON, _SET_APART = range(4)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once; inside a lambda a plain expression would be, again and again."""
    return F.transform(F.array(value), use)[0]


def _glue(a: Column, b: Column) -> Column:
    """What goes between two texts: nothing between wide letters, else a space."""
    tight = F.substring(a, -1, 1).rlike("[^\\x00-\\x7f]") & F.substring(b, 1, 1).rlike(N.CJK)
    return F.when(tight, F.lit("")).otherwise(F.lit(" "))


def _marks(lines: Column) -> Column:
    """Per line, whether it is dropped, begins a row, or stands further right on the row before it.

    A row is as wide and high as its lines so far; a line belongs to it that shares half the lower height of both,
    is of like height, and begins where the row ends.
    """
    none = F.lit(None).cast(_BOX)
    sides = ("left", "top", "right", "bottom")

    def step(acc: Column, x: Column) -> Column:
        row, tall = acc["row"], _height(acc["row"])
        low, high = F.least(tall, _height(x)), F.greatest(tall, _height(x))
        shared = F.least(row["bottom"], x["bottom"]) - F.greatest(row["top"], x["top"])
        behind = x["left"] - row["right"]
        on_it = row.isNotNull() & (shared >= 0.5 * low) & (low >= 0.6 * high) & (x["left"] >= row["right"] - 0.5 * tall)
        wider = F.struct(*[(F.least if k < 2 else F.greatest)(row[c], x[c]).alias(c) for k, c in enumerate(sides)])

        def marked(mark: Column, box: Column) -> Column:
            return F.struct(F.concat(acc["marks"], F.array(mark)).alias("marks"), box.alias("row"))

        return (
            F.when(~x["kept"], marked(F.lit(_DROPPED), none))
            .when(on_it, marked(F.when(behind > 0.5 * tall, _SET_APART).otherwise(_RUNS_ON), wider))
            .otherwise(marked(F.lit(_STARTS), F.struct(*[x[c].alias(c) for c in sides])))
        )

    def block(done: Column, k: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("marks"), F.get(done, F.size(done) - 1)["row"].alias("row"))
        return F.concat(done, F.array(F.aggregate(F.slice(lines, k * _BLOCK + 1, _BLOCK), start, step)))

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(lines) - 1) / _BLOCK).cast("int"), F.lit(0)))
    marks = F.aggregate(blocks, F.array().cast(f"array<struct<marks:array<int>,row:{_BOX}>>"), block, lambda done: F.flatten(F.transform(done, lambda d: d["marks"])))
    return F.when(lines.isNotNull(), marks)


def _row_of(part: Column, marks: Column, start: Column) -> Column:
    """Neighbouring lines as one row: their texts from left to right and the box around them all."""
    between = lambda x, j: (
        F.when(j == 0, F.lit("")).when(F.get(marks, start + j) == _SET_APART, F.lit(" ")).otherwise(_glue(F.get(part, j - 1)["text"], x["text"]))
    )
    text = F.array_join(F.transform(part, lambda x, j: F.concat(between(x, j), x["text"])), "")
    wide = N.cjk_count
    least, most = lambda c: F.array_min(part[c]), lambda c: F.array_max(part[c])
    return _let(text, lambda t: F.struct(
        t.alias("text"), least("left").alias("left"), least("top").alias("top"), most("right").alias("right"), most("bottom").alias("bottom"),
        ((most("right") - least("left")) / F.greatest(F.lit(1.0), wide(t) + 0.55 * (F.length(t) - wide(t)))).alias("letter"),
    ))


def _goes_on(above: Column, row: Column) -> Column:
    """Whether a row takes up the sentence above it: right below, letters of like width, set to the same edge or
    centre, and the row above filled and without a closing mark."""
    h = F.greatest(_height(above), _height(row))
    gap = row["top"] - above["bottom"]
    width, width_above = row["right"] - row["left"], above["right"] - above["left"]
    edge, centre = F.abs(row["left"] - above["left"]), F.abs((row["left"] + row["right"]) / 2 - (above["left"] + above["right"]) / 2)
    return (
        (gap >= 0) & (gap < h) & (F.least(edge, centre) < 1.5 * h) & (width_above >= 0.8 * width)
        & (F.least(above["letter"], row["letter"]) >= 0.8 * F.greatest(above["letter"], row["letter"]))
        & ~F.contains(F.lit(N.SENTENCE_ENDS), F.substring(above["text"], -1, 1))
    )


def join_wrapped(lines: Column) -> Column:
    """Lines (text, place, kept) back into sentences, one a line of the result, within each document's own array.

    One pass numbers the rows, as it has to know how far a row reaches; rows and sentences are then put together at
    once, a sentence going on from the row above only. A dropped line ends both. Null lines give null, none an empty text.
    """
    def rows(read: Column, marks: Column, starts: Column) -> Column:
        def row(start: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(read)) - start
            made = _let(F.slice(read, start + 1, size), lambda part: _row_of(part, marks, start))
            return F.when(F.get(marks, start) != _DROPPED, made)

        return F.transform(starts, row)

    def sentences(rows: Column) -> Column:
        def piece(row: Column, k: Column) -> Column:
            above = F.get(rows, k - 1)
            between = F.when(above.isNotNull() & _goes_on(above, row), _glue(above["text"], row["text"])).otherwise("\n")
            return F.when(row.isNotNull(), F.concat(between, row["text"]))

        return F.substr(F.array_join(F.transform(rows, piece), ""), F.lit(2))

    def begins(marks: Column) -> Column:
        return F.filter(F.transform(marks, lambda m, i: F.when(m <= _STARTS, i)), lambda i: i.isNotNull())

    return _let(lines, lambda read: _let(_marks(read), lambda marks: _let(begins(marks), lambda starts: _let(rows(read, marks, starts), sentences))))


def kept_lines(docs: DataFrame, at_least: int = COMMON_IN) -> DataFrame:
    """(id, lines): every line with its place and whether it is worth reading."""
    shared = common_per_document(docs, common_lines(docs, at_least))
    judged = F.transform(F.transform("lines", _read), _judge)
    read = docs.select("id", judged.alias("read")).join(shared, "id", "left")
    common = F.coalesce("common", F.array().cast("array<string>"))
    kept = F.transform(
        "read",
        lambda x, i: F.struct(
            x["text"].alias("text"), x["left"].alias("left"), x["top"].alias("top"), x["right"].alias("right"),
            x["bottom"].alias("bottom"),
            (~(x["furniture"] | x["chrome"] | x["account"] | F.array_contains(common, x["norm"]) | _context_drop(F.col("read"), x, i))).alias("kept"),
        ),
    )
    return read.select("id", kept.alias("lines"))


def main_text(docs: DataFrame, at_least: int = COMMON_IN) -> DataFrame:
    """(id, text): the document's own words, from (id, lines)."""
    return kept_lines(docs, at_least).select("id", join_wrapped(F.col("lines")).alias("text"))

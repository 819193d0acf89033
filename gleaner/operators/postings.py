"""A stored word index, and searches that read only the postings they need.

Three tables: `forward` (id, grams), `inverted` (gram, id) and `counts` (gram, df). Every file of `inverted` holds the
postings of some documents in order of gram: writing it moves no row between tasks, a frequent gram is spread over all
files, and what a document scores is summed where it lies. A gram adds the same weight to every document that holds it, so
the weight is the exact bound of its whole list. A document that is to reach a bound must hold one of the query's
rarest grams: those left out weigh less than the bound together. Only the lists of these grams are read; what a
candidate holds of the others is looked up in its own row of `forward`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.lexical import ITEM, QUERY, query_grams, score_hits, weigh
from gleaner.operators.ordering import top_k
from gleaner.session import BROADCAST_BYTES, broadcast_if_small, cut_lineage, measure, reading_parts, scratch

SHARE_DIGITS = 12
SLACK = 1e-9  # more than sums in another order can differ by, less than a weight
SORT_BYTES = 32 << 20  # of the stored rows whose postings one task sorts, so that they fit its memory
ROW_GROUP_BYTES = 8 << 20  # rows can be read in no smaller parts than these
SEED_POSTINGS = 8  # postings read per wanted place to learn a first bound


@dataclass(frozen=True)
class WordIndex:
    forward: DataFrame
    inverted: DataFrame
    counts: DataFrame
    size: DataFrame
    script_map: dict[str, str] | None = None


@dataclass(frozen=True)
class Wording:
    """(query, gram, df, idf, total, rest, before) of some queries: `idf` null for grams no document holds, `total` the
    weight of the whole wording, `rest` what the known grams after this one add together, the rarest first, `before`
    the postings of those in front. `small`: the rows are measured to fit a broadcast, and so do parts of them."""

    rows: DataFrame
    small: bool

    def known(self) -> DataFrame:
        return self.rows.filter(F.col("idf").isNotNull())

    def per_query(self, *values: Column) -> DataFrame:
        return self.hint(self.rows.groupBy(QUERY).agg(*values))

    def hint(self, part: DataFrame) -> DataFrame:
        return F.broadcast(part) if self.small else part


def write_index(docs: DataFrame, folder: str, script_map: dict[str, str] | None = None) -> WordIndex:
    """Write the index of `docs` (id, text; ids are unique) to `folder`; texts are read once."""
    spark = docs.sparkSession
    # the units are a column first: inside the pairs' function they would be worked out for each of its arguments
    read = docs.filter(F.length("text") > 0).select(ITEM, T.units(F.col("text"), script_map).alias("us"))
    read.select(ITEM, T.grams(F.col("us")).alias("grams")).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    lists = forward.select(F.explode("grams").alias("gram"), ITEM)
    with reading_parts(spark, SORT_BYTES):
        lists.sortWithinPartitions("gram", ITEM).write.parquet(f"{folder}/inverted")
    inverted = spark.read.parquet(f"{folder}/inverted")
    inverted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{folder}/counts")
    forward.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/size")
    return read_index(spark, folder, script_map)


def read_index(spark: SparkSession, folder: str, script_map: dict[str, str] | None = None) -> WordIndex:
    """The index written to `folder`; `script_map` is the one it was written with."""
    return WordIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("forward", "inverted", "counts", "size")], script_map)


def temporary_index(docs: DataFrame, script_map: dict[str, str] | None = None) -> WordIndex:
    return write_index(docs, scratch(docs.sparkSession, "words"), script_map)


def asked(queries: DataFrame, index: WordIndex) -> Wording:
    wanted = cut_lineage(query_grams(queries, index.script_map))
    few = measure(wanted) <= BROADCAST_BYTES
    grams = wanted.select("gram").distinct()
    known = weigh(index.counts.join(F.broadcast(grams) if few else grams, "gram"), index.size)
    weighed = wanted.join(known.drop("unseen"), "gram", "left").crossJoin(F.broadcast(index.size))
    whole = Window.partitionBy(QUERY)
    ask = F.coalesce("idf", F.ln((F.col("n") + 1) / F.lit(0.5)))
    rarest = whole.orderBy(F.asc_nulls_first("df"), "gram")
    rows = cut_lineage(weighed.select(
        QUERY, "gram", "df", "idf", F.sum(ask).over(whole).alias("total"),
        F.coalesce(F.sum("idf").over(rarest.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)).alias("rest"),
        F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    return Wording(rows, measure(rows) <= BROADCAST_BYTES)


def _partial(index: WordIndex, essential: DataFrame, wording: Wording) -> DataFrame:
    """(query, id, found): weight of the essential grams (query, gram, idf) each document holds."""
    grams = wording.hint(essential.select(QUERY, "gram", "idf"))
    return index.inverted.join(grams, "gram").groupBy(QUERY, ITEM).agg(F.sum("idf").alias("found"))


def shares_of(pairs: DataFrame, wording: Wording, index: WordIndex) -> DataFrame:
    """(query, id, share) of the given (query, id), by the documents' own rows; `wording` comes from `asked`.

    Pairs without any of the wording are absent. Where there are too many for a broadcast, their shares are summed
    from the lists instead: the rows of the documents hold all grams and would have to be shuffled.
    """
    pairs = cut_lineage(pairs.select(QUERY, ITEM))
    if measure(pairs) <= BROADCAST_BYTES:
        pairs = F.broadcast(pairs)
    elif wording.small:
        totals = wording.per_query(F.first("total").alias("_total"))
        summed = _partial(index, wording.known(), wording).join(pairs, [QUERY, ITEM]).join(totals, QUERY)
        return summed.select(QUERY, ITEM, F.round(F.col("found") / F.col("_total"), SHARE_DIGITS).alias("share"))
    known = F.when(F.col("idf").isNotNull(), F.struct("gram", "idf"))
    terms = wording.per_query(F.sort_array(F.collect_list(known)).alias("_terms"), F.first("total").alias("_total"))

    def found(held: Column) -> Column:
        return F.aggregate(F.filter("_terms", lambda t: F.array_contains(held, t["gram"])), F.lit(0.0), lambda s, t: s + t["idf"])

    # what both hold is worked out once a pair: the outer function binds it
    common = F.array_intersect("grams", F.transform("_terms", lambda t: t["gram"]))
    found_ = F.transform(F.array(common), found)[0]
    rows = index.forward.join(pairs, ITEM).join(terms, QUERY)
    scored = rows.select(QUERY, ITEM, found_.alias("_found"), F.col("_total"))
    return scored.filter(F.col("_found") > 0).select(QUERY, ITEM, F.round(F.col("_found") / F.col("_total"), SHARE_DIGITS).alias("share"))


def _candidates(wording: Wording, bounds: DataFrame, index: WordIndex) -> DataFrame:
    """(query, id, found, best) of all documents that may reach `bound` (query, bound); `best` is the most that their
    whole wording can weigh, `found` the weight already known."""
    known = wording.known().join(wording.hint(bounds), QUERY, "left").withColumn("_need", F.coalesce("bound", F.lit(0.0)) - SLACK)
    # a gram is essential if the documents that lack all rarer ones could still reach the bound
    essential = cut_lineage(known.filter(F.col("rest") + F.col("idf") >= F.col("_need")))
    missing = wording.hint(essential.groupBy(QUERY).agg(F.min("rest").alias("_rest"), F.first("_need").alias("_need")))
    some = _partial(index, essential, wording).join(missing, QUERY).withColumn("best", F.col("found") + F.col("_rest"))
    return some.filter(F.col("best") >= F.col("_need")).select(QUERY, ITEM, "found", "best")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(query, bound): the `k`-th greatest weight; queries with fewer documents have none."""
    first = top_k(found, [QUERY], [F.desc("found"), F.asc(ITEM)], k)
    return first.filter(F.col("rank") == k).select(QUERY, F.col("found").alias("bound"))


def shares_at_least(queries: DataFrame, index: WordIndex, floor: float, wording: Wording | None = None) -> DataFrame:
    """(query, id, share) of all documents with at least `floor` of the wording, 0 < floor."""
    wording = asked(queries, index) if wording is None else wording
    bounds = wording.per_query((F.first("total") * F.lit(floor)).alias("bound"))
    return shares_of(_candidates(wording, bounds, index), wording, index).filter(F.col("share") >= floor)


def top_shares(queries: DataFrame, index: WordIndex, k: int) -> DataFrame:
    """(query, id, share, rank): the `k` documents with most of the wording, equal shares by id.

    The rarest grams, as many as have some postings per place, give a first bound: what the `k`-th document has of
    them. It decides which lists are read; what these find gives the second bound, and only documents that may reach
    it are looked up.
    """
    wording = asked(queries, index)
    rare = wording.known().filter(F.col("before") < SEED_POSTINGS * k)
    some = cut_lineage(_candidates(wording, _kth(_partial(index, rare, wording), k), index))
    near = some.join(wording.hint(_kth(some, k)), QUERY, "left").filter(F.col("best") >= F.coalesce("bound", F.lit(0.0)) - SLACK)
    return top_k(shares_of(near, wording, index), [QUERY], [F.desc("share"), F.asc(ITEM)], k)


def all_shares(queries: DataFrame, index: WordIndex) -> DataFrame:
    """(query, id, share) of every document with any of the wording: as many rows as there are such pairs."""
    wanted = query_grams(queries, index.script_map)
    grams = broadcast_if_small(wanted.select("gram").distinct())
    hits = index.inverted.join(grams, "gram", "left_semi")
    return score_hits(wanted, hits, weigh(index.counts.join(grams, "gram", "left_semi"), index.size), index.size)

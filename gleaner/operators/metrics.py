"""Measuring rankings and scores. Everything is an aggregate; pairs of items are counted, never listed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.ordering import global_rank, running_sum
from gleaner.operators.similarity import pair_histogram
from gleaner.session import broadcast_if_small, cut_lineage

# The decision rules' defaults.
HYBRID_MIN_RECALL5 = 0.70
ROUTE_MIN_GAIN_POINTS = 15.0
QUOTE_THRESHOLD = 0.5
THRESHOLDS = [t / 100 for t in range(50, 100)]


def first_relevant(rankings: DataFrame, qrels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank of the first relevant item of every labeled query (null if it is not ranked), per method."""
    right = broadcast_if_small(qrels.select("query", F.col("relevant").alias("id")).distinct().withColumn("_right", F.lit(True)))
    marked = rankings.select(*keys, "query", "id", "rank").join(right, ["query", "id"], "left" if keys else "inner")
    found = marked.groupBy(*keys, "query").agg(F.min(F.when(F.col("_right"), F.col("rank"))).alias("first"))
    labeled = qrels.select("query").distinct()
    if keys:
        found = cut_lineage(found)  # the methods are read from it too, so the rankings are gone through once
        labeled = labeled.crossJoin(F.broadcast(found.select(*keys).distinct()))  # a handful of methods
    return labeled.join(found, [*keys, "query"], "left")


def _need(n: Column, value: Column, message: str) -> Column:
    return F.when(n > 0, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def _metrics(first: Column) -> dict[str, Column]:
    n = F.count(F.lit(1))
    none = "no labeled queries to score"
    return {
        "recall_1": _need(n, F.count_if(first <= 1) / n, none),
        "recall_5": _need(n, F.count_if(first <= 5) / n, none),
        "mrr": _need(n, F.avg(F.coalesce(1.0 / first, F.lit(0.0))), none),
    }


def recall_at_k(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    first = first_relevant(rankings, qrels)
    n = F.count(F.lit(1))
    return first.agg(n.alias("n"), _need(n, F.count_if(F.col("first") <= k) / n, "no labeled queries to score").alias("recall"))


def mrr(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    return first_relevant(rankings, qrels).agg(F.count(F.lit(1)).alias("n"), _metrics(F.col("first"))["mrr"].alias("mrr"))


def score_methods(rankings: DataFrame, qrels: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    first = first_relevant(rankings, qrels, keys)
    return first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(a) for a, c in _metrics(F.col("first")).items()])


def match_quality(matches: DataFrame, qrels: DataFrame) -> DataFrame:
    """Share of labeled queries with a relevant confident match, and confident matches that are not relevant."""
    right = qrels.select("query", F.col("relevant").alias("id")).distinct().withColumn("_right", F.lit(True))
    labeled = qrels.select("query").distinct()
    per_query = matches.join(labeled, "query", "left_semi").join(right, ["query", "id"], "left").groupBy("query").agg(
        F.max(F.coalesce("_right", F.lit(False))).alias("found"), F.count_if(F.col("_right").isNull()).alias("filler")
    )
    return labeled.join(per_query, "query", "left").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce("found", F.lit(False)).cast("double")).alias("match_recall"),
        F.avg(F.coalesce("filler", F.lit(0)).cast("double")).alias("filler_per_query"),
    )


def auc(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outscores a negative, ties half; from counts per distinct score."""
    per_score = scored.groupBy(*keys, "score").agg(
        F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg")
    )
    summed = running_sum(per_score, list(keys), [F.asc("score")], {"neg_upto": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    totals = summed.groupBy(*keys).agg(wins.alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    value = _need(both, F.col("wins") / both, "need at least one positive and one negative score")
    return totals.select(*keys, "n_pos", "n_neg", value.alias("auc"))


def _balanced(tp: Column, fn: Column, tn: Column, fp: Column) -> Column:
    # not their product: counts of pairs are too large to be multiplied as integers
    return _need(F.least(tp + fn, tn + fp), (tp / (tp + fn) + tn / (tn + fp)) / 2, "need both classes present")


def balanced_accuracy(df: DataFrame, label: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*keys).agg(
        F.count_if(label & predicted).alias("tp"), F.count_if(label & ~predicted).alias("fn"),
        F.count_if(~label & ~predicted).alias("tn"), F.count_if(~label & predicted).alias("fp"),
    )
    value = _balanced(F.col("tp"), F.col("fn"), F.col("tn"), F.col("fp"))
    return counts.select(*keys, "tp", "fn", "tn", "fp", value.alias("bal_acc"))


def sweep(histogram: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Balanced accuracy at each threshold, from pair counts per (bin, same)."""
    steps = F.explode(F.array([F.struct(F.lit(i + 1).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)]))
    at = histogram.select("*", steps.alias("s")).select(*keys, "bin", "same", "pairs", "s.step", "s.threshold")
    hit, same, n = F.col("bin") >= F.col("step"), F.col("same"), F.col("pairs")
    zero = F.lit(0)
    counts = at.groupBy(*keys, "threshold").agg(
        F.sum(F.when(hit & same, n).otherwise(zero)).alias("tp"), F.sum(F.when(~hit & same, n).otherwise(zero)).alias("fn"),
        F.sum(F.when(~hit & ~same, n).otherwise(zero)).alias("tn"), F.sum(F.when(hit & ~same, n).otherwise(zero)).alias("fp"),
    )
    value = _balanced(F.col("tp"), F.col("fn"), F.col("tn"), F.col("fp"))
    return counts.select(*keys, "threshold", value.alias("bal_acc"))


def best_threshold(swept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The lowest threshold that reaches the best balanced accuracy."""
    best = F.max(F.struct(F.col("bal_acc"), (-F.col("threshold")).alias("t")))
    return swept.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.t")).alias("threshold"), F.col("b.bal_acc").alias("bal_acc")
    )


def pair_sweep(items: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    return sweep(pair_histogram(items, list(thresholds)), thresholds)


def heldout_accuracy(items: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Pick the threshold on the pairs of one half of the groups, score it on the other half, both ways."""
    sides = global_rank(items.select("grp").distinct(), [], [F.asc("grp")], "place").select(
        "grp", ((F.col("place") - 1) % 2).cast("int").alias("side")
    )
    sided = items.join(sides, "grp")
    swept = sweep(pair_histogram(sided, list(thresholds), side="side"), thresholds, ["side"])
    picked = best_threshold(swept, ["side"]).select((1 - F.col("side")).alias("side"), "threshold")
    return swept.join(picked, ["side", "threshold"]).agg(F.avg("bal_acc").alias("bal_acc"))


def same_pattern(items: DataFrame) -> DataFrame:
    """Balanced accuracy of "equal normalised pattern means same group" over all pairs, from group sizes."""
    keyed = items.select("grp", T.normalize_pattern(F.col("text")).alias("key"))

    def pairs_within(*cols: str) -> DataFrame:
        sized = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        return sized.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))

    total = pairs_within().select(F.col("p").alias("total"))
    both = pairs_within("grp", "key").select(F.col("p").alias("tp"))
    group = pairs_within("grp").select(F.col("p").alias("same"))
    key = pairs_within("key").select(F.col("p").alias("equal"))
    one = total.crossJoin(both).crossJoin(group).crossJoin(key)  # four single rows
    tp, fn, fp = F.col("tp"), F.col("same") - F.col("tp"), F.col("equal") - F.col("tp")
    tn = F.col("total") - F.col("same") - fp
    return one.select("tp", fn.alias("fn"), tn.alias("tn"), fp.alias("fp"), _balanced(tp, fn, tn, fp).alias("bal_acc"))


def query_overlap(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Largest share of each labeled query's wording found in one of its relevant documents."""
    q = queries.select("query", T.norm(F.col("text")).alias("_q"))
    d = docs.select(F.col("id").alias("relevant"), T.norm(F.col("text")).alias("_t"))
    pairs = qrels.select("query", "relevant").distinct().join(q, "query").join(d, "relevant")
    return pairs.select("query", T.quote_overlap(F.col("_q"), F.col("_t")).alias("o")).groupBy("query").agg(
        F.max("o").alias("overlap")
    )


def score_by_quote(rankings: DataFrame, qrels: DataFrame, overlaps: DataFrame, threshold: float = QUOTE_THRESHOLD) -> DataFrame:
    """Metrics per method for queries that quote a relevant text and for those that describe it."""
    subset = F.when(F.col("overlap") >= threshold, "quote_like").otherwise("descriptive").alias("subset")
    first = first_relevant(rankings, qrels, ["method"]).join(overlaps.select("query", subset), "query")
    return first.groupBy("subset", "method").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(a) for a, c in _metrics(F.col("first")).items()]
    )


def decisions(scores: DataFrame) -> DataFrame:
    """Whether the fused search is good enough, and whether descriptions add enough to pay for."""
    row = scores.groupBy().pivot("method", ["ocr", "vlm", "hybrid"]).agg(F.first("recall_5"))
    gain = F.round((F.col("vlm") - F.col("ocr")) * 100, 1)
    return row.select(
        (F.col("hybrid") >= HYBRID_MIN_RECALL5).alias("hybrid_passes"), gain.alias("gain_points"),
        (gain >= ROUTE_MIN_GAIN_POINTS).alias("keep_route"),
    )

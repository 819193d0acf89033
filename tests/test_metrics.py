"""Metrics on hand-made rankings, and AUC against the definition."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleaner.operators import metrics as M


@pytest.fixture(scope="module")
def ranked(spark):
    """Forty rankings of up to thirty items, drawn at random; each query's relevant item may be missing from its own."""
    rng = np.random.default_rng(29)
    lists = {q: [int(i) for i in rng.permutation(40)[: rng.integers(3, 31)]] for q in range(40)}
    relevant = {q: int(rng.integers(0, 40)) for q in lists}
    rows = [(q, i, n) for q, ids in lists.items() for n, i in enumerate(ids, 1)]
    tables = spark.createDataFrame(rows, "query int, id int, rank int"), spark.createDataFrame(list(relevant.items()), "query int, relevant int")
    return *tables, lists, relevant


def test_recall_and_mrr(ranked):
    rankings, labels, lists, relevant = ranked
    for k in (1, 4, 17):
        assert M.recall_at_k(rankings, labels, k).first().recall == pytest.approx(np.mean([relevant[q] in ids[:k] for q, ids in lists.items()]))
    want = np.mean([1 / (1 + ids.index(relevant[q])) if relevant[q] in ids else 0.0 for q, ids in lists.items()])
    assert M.mrr(rankings, labels).first().mrr == pytest.approx(want)


def test_no_labeled_query_is_an_error(spark, ranked):
    with pytest.raises(PySparkException, match="no labeled queries"):
        M.mrr(ranked[0], ranked[1].filter("false")).collect()


def test_match_quality(ranked):
    """Every third place counts as a match; the share of relevant items among them, and what else comes along."""
    rankings, labels, lists, relevant = ranked
    row = M.match_quality(rankings.filter("rank % 3 = 0").select("query", "id"), labels).first()
    found = {q: ids[2::3] for q, ids in lists.items()}
    hits = [relevant[q] in ids for q, ids in found.items()]
    others = [sum(i != relevant[q] for i in ids) for q, ids in found.items()]
    assert (row.n, row.match_recall, row.filler_per_query) == (40, pytest.approx(np.mean(hits)), pytest.approx(np.mean(others)))


def _scored(spark, pos, neg):
    return spark.createDataFrame([(float(s), True) for s in pos] + [(float(s), False) for s in neg], "score double, label boolean")


@pytest.mark.parametrize("seed,n_pos,n_neg,levels", [(5, 300, 200, 30), (6, 1, 70, 4), (7, 40, 1, 2)])
def test_auc(spark, seed, n_pos, n_neg, levels):
    rng = np.random.default_rng(seed)
    pos, neg = rng.integers(1, levels + 1, n_pos) / 10, rng.integers(0, levels, n_neg) / 10
    want = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)])
    assert M.auc(_scored(spark, pos, neg)).first().auc == pytest.approx(want)


def test_auc_needs_both_labels(spark):
    for pos, neg in (([0.3, 0.2], []), ([], [0.7])):
        with pytest.raises(PySparkException, match="at least one"):
            M.auc(_scored(spark, pos, neg)).collect()


def _balanced(labels, said):
    return np.mean([np.mean([s == v for l, s in zip(labels, said) if l == v]) for v in (True, False)])


def test_balanced_accuracy(spark):
    rng = np.random.default_rng(8)
    labels, said = rng.random(150) < 0.2, rng.random(150) < 0.6
    df = spark.createDataFrame([(bool(a), bool(b)) for a, b in zip(labels, said)], "l boolean, p boolean")
    assert M.balanced_accuracy(df, F.col("l"), F.col("p")).first().bal_acc == pytest.approx(_balanced(labels, said))


def test_heldout_uses_the_other_half_only(spark):
    """Seven drawn groups; the halves are every other group by name, pairs across halves count for neither."""
    rng = np.random.default_rng(31)
    items = []
    for name in "pqrstuv":
        middle = rng.normal(size=5)
        for _ in range(int(rng.integers(2, 6))):
            v = middle + rng.normal(size=5) * rng.choice([0.2, 1.0])
            items.append((len(items), [float(x) for x in v / np.linalg.norm(v)], name))
    halves = [[(np.dot(a[1], b[1]), a[2] == b[2]) for a, b in itertools.combinations(items, 2) if {a[2], b[2]} <= set("pqrstuv"[k::2])] for k in (0, 1)]
    at = [{t: _balanced([same for _, same in pairs], [s >= t for s, _ in pairs]) for t in M.THRESHOLDS} for pairs in halves]
    picked = [max(scores, key=lambda t, scores=scores: (scores[t], -t)) for scores in at]
    got = M.heldout_accuracy(spark.createDataFrame(items, "id bigint, vec array<double>, grp string")).first().bal_acc
    assert got == pytest.approx((at[0][picked[1]] + at[1][picked[0]]) / 2)


def test_lowest_best_threshold(spark):
    hist = spark.createDataFrame([(0, False, 5), (2, True, 3), (3, True, 1)], "bin int, same boolean, pairs bigint")
    best = M.best_threshold(M.sweep(hist, [0.5, 0.6, 0.7])).first()
    assert (best.threshold, best.bal_acc) == (0.5, 1.0)


def test_decisions(spark):
    scores = spark.createDataFrame([("ocr", 0.6), ("vlm", 0.8), ("hybrid", 0.72)], "method string, recall_5 double")
    row = M.decisions(scores).first()
    assert (row.hybrid_passes, row.gain_points, row.keep_route) == (True, 20.0, True)


def test_same_pattern_counts_all_pairs(spark):
    items = [("g1", "{X}!"), ("g1", "X"), ("g1", "other"), ("g2", "[Y]"), ("g3", "else")]
    row = M.same_pattern(spark.createDataFrame(items, "grp string, text string")).first()
    assert (row.tp, row.fn, row.fp, row.tn) == (1, 2, 2, 5)


def test_counts_of_pairs_may_be_large(spark):
    """Pairs of a class times pairs of the other exceed 64 bits long before either does."""
    bins = spark.createDataFrame([(1, True, 4 * 10**12), (0, True, 10**12), (1, False, 10**12), (0, False, 9 * 10**12)], "bin int, same boolean, pairs bigint")
    assert M.sweep(bins, [0.5]).first()["bal_acc"] == pytest.approx((0.8 + 0.9) / 2)
    groups = spark.range(4_000_000).selectExpr("cast(id % 2 as string) AS grp", "cast(id % 2 as string) AS text")
    row = M.same_pattern(groups).first()
    assert (row.tp, row.fn, row.tn, row.fp, row.bal_acc) == (2 * (2_000_000 * 1_999_999 // 2), 0, 2_000_000**2, 0, 1.0)

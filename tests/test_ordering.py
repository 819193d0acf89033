"""Ranks and neighbours when one key holds most rows and spans many partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators.joins import lookup_join
from gleaner.operators.ordering import global_rank, neighbours, running_sum, stable_sorted, top_k


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(1)
    n = 6000
    return pd.DataFrame({
        "key": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 40, n).astype(str)),
        "score": rng.integers(0, 50, n), "id": rng.permutation(n), "x": rng.integers(0, 9, n),
    })


@pytest.fixture(params=[1, 16])
def partitions(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rank_of_a_key_that_spans_partitions(spark, hot, partitions):
    df = spark.createDataFrame(hot)
    order = [F.desc("score"), F.asc("id")]
    if partitions > 1:
        spread = stable_sorted(df, ["key"], order).filter("key = 'hot'").select("_part").distinct().count()
        assert spread > 3
    got = global_rank(df, ["key"], order).toPandas().set_index("id")["rank"].sort_index()
    want = hot.sort_values(["score", "id"], ascending=[False, True])
    want = (want.groupby("key").cumcount() + 1).set_axis(want["id"]).sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()


def test_running_sum_and_neighbours(spark, hot, partitions):
    df = spark.createDataFrame(hot)
    got = running_sum(df, ["key"], [F.asc("id")], {"upto": "x"}).toPandas().sort_values("id")
    want = hot.sort_values("id")
    assert got["upto"].tolist() == want.groupby("key")["x"].cumsum().tolist()
    near = neighbours(df, ["key"], [F.asc("id")], lag={"before": "x"}, lead={"after": "x", "next_id": "id"}).toPandas().sort_values("id")
    for column, shift, source in (("before", 1, "x"), ("after", -1, "x"), ("next_id", -1, "id")):
        assert near[column].fillna(-1).tolist() == want.groupby("key")[source].shift(shift).fillna(-1).tolist()


def test_rank_without_a_key(spark, hot, partitions):
    got = global_rank(spark.createDataFrame(hot), [], [F.asc("id")]).toPandas()
    assert (got["rank"] == got["id"] + 1).all()


def test_top_k(spark, hot):
    got = top_k(spark.createDataFrame(hot), ["key"], [F.desc("score"), F.asc("id")], 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    want = hot.sort_values(["score", "id"], ascending=[False, True]).groupby("key").head(3)
    assert sorted(r.id for r in got.collect()) == sorted(want["id"])


def test_lookup_join_is_a_left_join(spark, hot):
    df = spark.createDataFrame(hot)
    lookup = df.filter("key <> '7'").groupBy("key").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    got = lookup_join(df, lookup, "key", "n", [F.col("id")], hot_keys=5).toPandas().sort_values("id")
    sizes = hot[hot["key"] != "7"].groupby("key").size()
    assert got["n"].fillna(0).tolist() == hot.sort_values("id")["key"].map(sizes).fillna(0).tolist()

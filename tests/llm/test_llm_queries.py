"""The registered queries on the smallest tables: against their SQL where they have one, else their shape."""

import pytest

from gleaner.llm.registry import ORACLES, QUERIES
from tests.oracle import check, connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_embedding_near_dedup": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op4_simhash": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op5_toxicity": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op7_language": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op10_sentencepiece": ("documents", ["doc_id", "n_tokens", "skipped", "ids_sha256", "lossless"]),
    "op13_token_alignment": ("documents", ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]),
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, name, FOLDER) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_every_row(spark, name):
    table, columns = COLUMNS[name]
    got = QUERIES[name](spark, FOLDER)
    assert got.columns == columns
    assert got.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"} == set(range(1, 14)) and "pipeline" in QUERIES

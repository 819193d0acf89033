"""All queries of the operators here, the pipeline included, as the driver's entry adds them."""

import corpus_pipeline
from gleaner.llm import queries  # noqa: F401  registers the queries
from gleaner.llm.common import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]

"""All named queries."""

from ledgerspark.plans import graph_queries, label_queries, ingest_queries, case_queries, trace_queries  # noqa: F401
from ledgerspark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

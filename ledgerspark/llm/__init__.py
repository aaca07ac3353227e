"""Operators of a training-data pipeline; nothing else in the library imports this folder."""

from ledgerspark.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

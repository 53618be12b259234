"""Registered signal queries and their SQL."""

from __future__ import annotations

from . import sequence_queries, vector_queries

FLAGSHIP = "stft_events"


def queries():
    return {**sequence_queries.QUERIES, **vector_queries.QUERIES}


def oracle_sql():
    return {**sequence_queries.ORACLES, **vector_queries.ORACLES}

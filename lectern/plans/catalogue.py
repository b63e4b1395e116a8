"""The registered queries and their DuckDB oracles, gathered from the catalogue's parts."""

from __future__ import annotations

from lectern.plans import banks, cleaning, documents, extracts, pages, papers, segments, sequences, stores, streams

PARTS = (banks, sequences, documents, cleaning, extracts, segments, pages, papers, stores, streams)


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}

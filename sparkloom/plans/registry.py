"""Registration of queries with their oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def put(f):
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return put

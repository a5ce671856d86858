"""The registered queries and their SQL."""

from __future__ import annotations

from .derived import PAIRS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, pairs: bool = False):
    """Registers a query and its SQL; pairs: the SQL goes on from the classified pairs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (PAIRS_SQL if pairs else "") + sql
        return f

    return add

"""Where queries register themselves, each with its SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = False):
    from chargelens.plans import views as V

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {V.SQL} {sql}" if views else sql
        return f

    return put

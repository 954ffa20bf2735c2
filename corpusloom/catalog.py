"""Every registered query and its SQL, gathered from the modules of corpusloom.plans."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from corpusloom import plans

    plans.load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL

"""The table of checked queries."""

from __future__ import annotations

from checks.tables import Tables, plain

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, build, oracle: str | None = None) -> None:
    """Register ``build`` (a function of the tables) and the SQL for the same rows."""
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
    if oracle is not None:
        ORACLES[name] = oracle

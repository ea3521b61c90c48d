"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from . import constructed, relational, roundtrips, tabletexts  # noqa: F401  (the last two add to those of relational)


def queries() -> dict[str, relational.Query]:
    return relational.QUERIES | {name: made.query() for name, made in constructed.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return relational.SQL | {name: made.sql() for name, made in constructed.QUERIES.items()}

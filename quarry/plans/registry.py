"""All registered queries and their SQL."""

from __future__ import annotations

from quarry.plans import core


def queries() -> dict[str, core.Query]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)

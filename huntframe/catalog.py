"""Names the log queries and their SQL twins."""

from __future__ import annotations

from huntframe.plans import oracle
from huntframe.plans import queries as registered

FLAGSHIP = "auth_failure_spike"


def queries() -> dict:
    return registered.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()

"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from ledgerlens.plans import audit, checks, lifecycle, recordings, results, scalars, tables

QUERIES = {**recordings.QUERIES, **audit.QUERIES, **checks.QUERIES, **scalars.QUERIES, **lifecycle.QUERIES, **tables.QUERIES, **results.QUERIES}
ORACLE_SQL = {**recordings.ORACLE_SQL, **audit.ORACLE_SQL, **checks.ORACLE_SQL, **scalars.ORACLE_SQL, **lifecycle.ORACLE_SQL, **tables.ORACLE_SQL, **results.ORACLE_SQL}

"""Every registered query over the driver's tables, with the SQL that states its result."""

from __future__ import annotations

from . import incremental_queries, rule_queries, scope_queries, stage_queries, table_queries

QUERIES = {**rule_queries.QUERIES, **table_queries.QUERIES, **stage_queries.QUERIES, **scope_queries.QUERIES, **incremental_queries.QUERIES}
ORACLE_SQL = {**rule_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **stage_queries.ORACLE_SQL, **scope_queries.ORACLE_SQL, **incremental_queries.ORACLE_SQL}
flagship = rule_queries.canonical_share

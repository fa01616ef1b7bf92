"""Registered plans and their SQL."""

from . import flow, flow_sql, oracle, queries

QUERIES = {**queries.QUERIES, **flow.QUERIES}
ORACLE_SQL = {**oracle.ORACLE_SQL, **flow_sql.ORACLE_SQL}

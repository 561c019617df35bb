"""All registered queries with their SQL oracles."""

from __future__ import annotations

from . import relational, sketch_queries, statistics

QUERIES = relational.QUERIES | sketch_queries.QUERIES | statistics.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | sketch_queries.ORACLE_SQL | statistics.ORACLE_SQL

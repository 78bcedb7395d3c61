"""All registered queries outside the corpus operators, and their SQL."""

from __future__ import annotations

from tidemark.plans import bar_queries, desk_queries, flow_queries, model_queries, robust_queries, score_queries, state_queries

QUERIES = {**bar_queries.QUERIES, **flow_queries.QUERIES, **model_queries.QUERIES, **desk_queries.QUERIES, **score_queries.QUERIES, **state_queries.QUERIES, **robust_queries.QUERIES}
ORACLE_SQL = {**bar_queries.ORACLE_SQL, **flow_queries.ORACLE_SQL, **desk_queries.ORACLE_SQL, **score_queries.ORACLE_SQL, **state_queries.ORACLE_SQL, **robust_queries.ORACLE_SQL}

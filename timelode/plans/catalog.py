"""The registered queries of the engine and their DuckDB counterparts."""

from timelode.plans import label_queries, report_queries, task_queries

QUERIES: dict = {**label_queries.QUERIES, **report_queries.QUERIES, **task_queries.QUERIES}
ORACLES: dict = {**label_queries.ORACLES, **report_queries.ORACLES, **task_queries.ORACLES}

"""The registry of queries over the driver's tables and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chain_queries, detection_queries, pooled, source_queries, spatial_queries, statistics_queries, surface_queries

Query = Callable[[SparkSession, str], DataFrame]

_FAMILIES = (pooled, spatial_queries, statistics_queries, detection_queries, source_queries, surface_queries, chain_queries)
QUERIES: dict[str, Query] = {k: v for f in _FAMILIES for k, v in f.QUERIES.items()}


def _counted(sql: str) -> str:
    """count_if(test) as count(*) FILTER (test), which DuckDB gives as a BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER ({sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


ORACLE_SQL: dict[str, str] = {k: _counted(v) for f in _FAMILIES for k, v in f.ORACLE_SQL.items()}

"""The registry of the library's own queries: name -> (Spark plan, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "w9_interpolate"
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: put a query into the registry under its name."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = (f, sql)
        return f

    return put


def _load() -> None:
    """The query modules register themselves when they are imported."""
    from canopyflow.plans import cluster_queries, column_queries, geometry_queries, graph_queries, label_queries, overlay_queries, raster_queries, report_queries, series_queries, table_queries, tracking_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _QUERIES.items() if s}

"""All queries of the core."""

from lectern.plans import engine_queries, qa_queries, snapshot_queries  # noqa: F401
from lectern.plans.registry import CORE, Query


def queries() -> dict[str, Query]:
    """Name → callable(spark, folder)."""
    return dict(CORE.queries)


def oracle_sql() -> dict[str, str]:
    """Name → equivalent SQL for those queries that SQL can express."""
    return dict(CORE.sql)

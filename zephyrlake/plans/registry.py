"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from zephyrlake.plans import queries_api, queries_domain, queries_feeds, queries_models, queries_series, queries_serving, queries_table, queries_training


def queries() -> dict[str, Callable]:
    """Queries by name."""
    return {**queries_table.QUERIES, **queries_series.QUERIES, **queries_domain.QUERIES, **queries_api.QUERIES, **queries_training.QUERIES, **queries_models.QUERIES, **queries_feeds.QUERIES, **queries_serving.QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {**queries_table.SQL, **queries_series.SQL, **queries_domain.SQL, **queries_api.SQL, **queries_training.SQL, **queries_models.SQL, **queries_feeds.SQL, **queries_serving.SQL}

"""Registered queries (one module per area) and their DuckDB oracle SQL."""

from cartlens.plans import registry
from cartlens.plans import (catalogue, checks, cleaning, collaborative, content, dashboard, hybrid,  # noqa: F401
                            requested)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)

"""Event precedence and implicit-feedback scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dedup precedence of event types (higher wins).
EVENT_PRECEDENCE = {"view": 1, "click": 2, "add_to_cart": 3, "rating": 4, "purchase": 5}

# Score of each event type; unknown types score 1.0.
EVENT_WEIGHTS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0, "rating": 4.0}
UNKNOWN_EVENT_WEIGHT = 1.0

EVENT_TYPES = ("view", "click", "add_to_cart", "purchase", "rating")


def _lookup(col: Column, table: dict, default) -> Column:
    expr = None
    for key, value in table.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(col == key, F.lit(value))
    return expr.otherwise(F.lit(default))


def event_precedence(event_type: Column) -> Column:
    """view 1 < click 2 < add_to_cart 3 < rating 4 < purchase 5; unknown -> null."""
    return _lookup(event_type, EVENT_PRECEDENCE, None).cast("int")


def event_score(event_type: Column, rating: Column) -> Column:
    """A rating event with a positive rating scores the rating; else the type weight."""
    by_type = _lookup(event_type, EVENT_WEIGHTS, UNKNOWN_EVENT_WEIGHT).cast("double")
    return (
        F.when((event_type == "rating") & rating.isNotNull() & (rating > 0), rating.cast("double"))
        .otherwise(by_type)
    )

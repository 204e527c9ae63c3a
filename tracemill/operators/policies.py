"""Which views of an observation a prompt may hold, and how much each is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import KIND_WEIGHT

FULL = 3


def _full() -> Column:
    return F.array(F.lit(FULL))


def baseline_views(levels: Column) -> Column:
    """The full view, always."""
    return _full()


def immediate_views(levels: Column, pinned: Column, tier: Column) -> Column:
    """All views there are, of a pinned observation only the full one."""
    return F.when(pinned | (tier == "PINNED"), _full()).otherwise(F.array_sort(levels))


def posterior_views(levels: Column, pinned: Column, tier: Column, stage: Column) -> Column:
    """All views of an observation that a later action has enriched, once it is neither hot nor pinned; else the full one."""
    return F.when((stage != "ENRICHED") | pinned | tier.isin("HOT", "PINNED"), _full()).otherwise(F.array_sort(levels))


def importance(kind: Column, relevance: Column, recency: Column, *, by_relevance: float = 1.0, by_recency: float = 0.5) -> Column:
    """The kind's weight (1 for others) times 1 + relevance, up to 10, and the inverse of the recency rank, by their weights."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_WEIGHT.items() for x in kv)), kind), F.lit(1.0))
    return weight * (1.0 + by_relevance * F.least(F.coalesce(relevance, F.lit(0.0)), F.lit(10.0)) + by_recency / (recency + 1))


def full_plan(views: DataFrame, task: str, id_col: str) -> DataFrame:
    """(task, id, level, tokens) of the full views (task, id, level, tokens): everything stays."""
    return views.where(F.col("level") == FULL).select(task, id_col, "level", "tokens")

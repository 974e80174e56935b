"""All queries; importing a module registers its own."""

from . import augment_queries, compose_queries, metric_queries, pair_queries, text_queries
from .queries import oracle_sql, queries

__all__ = ["augment_queries", "compose_queries", "oracle_sql", "pair_queries", "queries", "metric_queries", "text_queries"]

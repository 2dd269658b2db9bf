"""All registered queries with their DuckDB check texts."""

from premisa.catalogue import (  # noqa: F401
    analysis_queries,
    fit_queries,
    metric_queries,
    text_queries,
    vector_queries,
)
from premisa.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries of the survey engine and the SQL each is checked against."""

from __future__ import annotations

from surveyloom.catalog import analytics_queries, dsl_queries, kpi_queries, listing_queries, org_queries, people_queries, prompt_queries  # noqa: F401
from surveyloom.catalog._base import ORACLE_SQL, QUERIES

FLAGSHIP = "dsl_metric_by_dimension"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

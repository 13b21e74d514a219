"""All registered queries."""

from __future__ import annotations

from workload import cleaning, files, grid_and_chart, multivariate, profiles, sql_surface  # noqa: F401
from workload.registry import QUERIES, Tables

__all__ = ["QUERIES", "Tables"]

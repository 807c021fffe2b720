"""Named queries over the test tables, and their DuckDB equivalents."""

from loomwork.plans import coverage, mechanisms  # noqa: F401 - add their queries
from loomwork.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All registered queries."""

from lodestar.plans import catalog_reports, catalog_tables, catalog_vectors
from lodestar.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_reports", "catalog_tables", "catalog_vectors"]

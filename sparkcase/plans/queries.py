"""All registered queries and their SQL."""

from . import catalog, catalog_cases, catalog_measures  # noqa: F401  each adds its queries

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL

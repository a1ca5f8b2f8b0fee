"""Every registered query beside the SQL that must give the same rows."""

from tabprofile.catalog import modelling, plans, profiles, relations, runs, tables  # noqa: F401
from tabprofile.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

"""Registered queries, the inputs derived for them, and the SQL they are compared with."""

from . import catalogue, file_catalogue
from .registry import oracle_sql, queries

__all__ = ["catalogue", "file_catalogue", "oracle_sql", "queries"]

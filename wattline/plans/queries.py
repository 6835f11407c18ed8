"""All registered queries and their SQL."""

from . import archive_queries, feed_queries, sql_queries  # noqa: F401 - each registers its queries
from .table_queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All queries of the library; importing the package registers them."""

from ..registry import ORACLES, QUERIES
from . import ask_queries, domain_queries, index_queries, search_queries, source_queries, table_queries

__all__ = ["ORACLES", "QUERIES", "ask_queries", "domain_queries", "index_queries", "search_queries", "source_queries", "table_queries"]

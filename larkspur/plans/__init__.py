"""The registered queries: operators applied to the driver's tables, with their DuckDB equivalents."""

from . import callgraph, code, memory, retrieval, search, streams, tables  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

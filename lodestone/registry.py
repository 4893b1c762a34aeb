"""All queries of the library by name, and their DuckDB twins."""

from .plans import files, learning, offline, search, text_web  # noqa: F401
from .plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

"""All queries of the core library."""

from . import file_queries, queries  # noqa: F401 (they register themselves)
from .registry import QUERIES, SQL  # noqa: F401

"""All registered queries."""

from .registry import CHECK_SQL, QUERIES
from . import q_keys, q_rollups, q_tables, q_text  # noqa: F401

__all__ = ["CHECK_SQL", "QUERIES"]

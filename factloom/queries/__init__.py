"""Core queries; importing this package registers all of them."""

from ..registry import ORACLE_SQL, QUERIES
from . import derive, drafting, governance, inferring, reads, temporal, wider  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]

"""The registered queries of the library."""

from tessera.plans import chunks, flows, members, rules, search  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

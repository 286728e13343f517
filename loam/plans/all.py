"""Every registered query of the library, with its SQL."""

from loam.plans import kept, many, searches, trees  # noqa: F401  they register their queries
from loam.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

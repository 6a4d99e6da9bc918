"""Every query by its name, and its SQL."""

from siltbed.plans import archive, frames, media, meters, names, pictures, scalars, stores, streams  # noqa: F401  they register their queries
from siltbed.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Named queries over the driver tables and the SQL that checks them."""

from . import fixture_sql, shared, footprint, levels, model, climate, surface, particles, ensemble, stored, files  # noqa: F401,I001
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

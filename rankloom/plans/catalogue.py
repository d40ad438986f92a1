"""Every query of the library by name, and DuckDB SQL for those that SQL expresses."""

from . import catalogue_generated  # noqa: F401  registers its queries
from .catalogue_legal import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

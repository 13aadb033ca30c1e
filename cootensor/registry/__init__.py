"""Named queries over the driver's tables (Spark side) and their DuckDB oracles."""

from .oracle import ORACLE_SQL
from .spark_side import QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

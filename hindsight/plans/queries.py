"""All queries of the engine's own operators."""

from ..functions import scalars  # noqa: F401
from ..operators import aggregates, audit, controls, decisions, evaluation, folds, nearest, pit, predicates, routing, selection, sequential, tables, windows  # noqa: F401
from ..sources import details, scans  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

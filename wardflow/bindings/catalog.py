"""All registered queries; importing the modules below registers them."""

from wardflow.bindings import basics, composites, operations, stored, upkeep  # noqa: F401
from wardflow.bindings.registry import CHECKS, QUERIES, bound, check_sql

__all__ = ["CHECKS", "QUERIES", "bound", "check_sql"]

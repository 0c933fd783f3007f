"""The driver tables cast in the roles the operators expect, and the registered queries."""

from railweave.plans import live, questions, search, state, tables  # noqa: F401
from railweave.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

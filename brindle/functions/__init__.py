"""Scalar and aggregate functions by name: ``call("levenshtein", a, b)``."""

from . import aggregates, documents, numeric, spatial, system, temporal, text, vectors  # noqa: F401
from . import documented  # noqa: F401  (it builds on the names before)
from .registry import AGGREGATE, SCALAR, aggregate, call, scalar

__all__ = ["AGGREGATE", "SCALAR", "aggregate", "call", "scalar"]

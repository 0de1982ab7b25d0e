"""All registered queries of the core: importing the binding modules fills the registry."""

from __future__ import annotations

from .bindings import aggregates, documents, folds, intervals, joins, pipelines, scalars, sequences  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Importing this module registers every query."""

from wardlens.plans import catalog, charts, documents, explore, features, kpis, models, priority, quality, questions, reports, retrieval, sources  # noqa: F401
from wardlens.plans.registry import ORACLES, PLANS, bound_queries

__all__ = ["ORACLES", "PLANS", "bound_queries"]

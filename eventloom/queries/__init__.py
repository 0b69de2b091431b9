"""Registered queries: the operators applied to the supplied tables, each with its SQL counterpart."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import flagship, q_cohort, q_concepts, q_eval, q_features, q_indicators, q_models, q_sources, q_windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]

"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ["indicators", "feature_queries", "aggregate_queries", "decision_queries", "table_queries", "search_queries",
           "stream_queries"]


def load():
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
    from tidemark.plans.registry import REGISTRY

    return REGISTRY

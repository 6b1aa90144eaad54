"""Runnable queries over the provided tables."""

from __future__ import annotations

import importlib

MODULES = ["pricing", "period", "sessionize", "text", "session", "allocation", "event", "segment", "log", "streaming", "store"]


def load_all():
    from sessionledger.plans.registry import CATALOGUE

    for m in MODULES:
        importlib.import_module(f"sessionledger.plans.{m}_queries")
    return CATALOGUE

"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["climate", "events", "relations", "statistics", "descriptors", "reports", "jobs", "geometry", "tables", "bootstraps", "functions", "surrogate_jobs", "verdicts", "coupled", "associations", "batches"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"sedge.plans.{name}")

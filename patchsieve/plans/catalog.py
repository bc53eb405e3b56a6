"""Loads every query module."""

from importlib import import_module

from patchsieve.plans.registry import ORACLES, QUERIES

MODULES = ["ranking", "metrics", "functions", "diffs", "history", "labels", "attribution", "report", "stats", "populations", "sources", "models"]

for _name in MODULES:
    import_module(f"patchsieve.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]

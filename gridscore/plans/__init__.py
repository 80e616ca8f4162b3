"""Registered queries, by subject."""

from __future__ import annotations

from importlib import import_module

MODULES = ("reports", "annotations", "runs", "items", "analysis", "progress", "errors", "export", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"gridscore.plans.{name}")

"""Imports every module that registers queries."""

import importlib

NAMES = ["scoring", "relational", "metrics", "text", "graph", "retrieval", "projects"]


def load() -> None:
    for name in NAMES:
        importlib.import_module(f"kvasir.plans.{name}")

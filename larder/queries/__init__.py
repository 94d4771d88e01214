"""Registered queries by area."""

from importlib import import_module

AREAS = ["scoring", "catalog", "sync", "search", "codes", "history", "normalize", "evidence", "regulation"]


def load_all() -> None:
    for area in AREAS:
        import_module(f"larder.queries.{area}")

"""Queries over the given tables, grouped by area."""
from importlib import import_module

AREAS = ["timeline", "text", "gate", "similarity", "evaluation", "privacy", "dialogue", "experiments", "profiles", "requests"]


def load_all() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")

"""Queries by area."""

from importlib import import_module

AREAS = ("retrieval", "evaluation", "cleaning", "ingest", "logs", "curation", "streams")


def load() -> None:
    for area in AREAS:
        import_module(f"gleaner.plans.{area}")

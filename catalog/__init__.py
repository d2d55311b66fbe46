"""Registered queries over the driver's tables."""

from importlib import import_module

FAMILIES = ("hospital_queries", "study_queries", "summary_queries", "model_queries", "condition_queries", "tree_queries", "source_queries")


def load():
    for family in FAMILIES:
        import_module(f"catalog.{family}")
    from catalog import registry
    return registry

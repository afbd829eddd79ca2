"""Named queries over the test tables, one module per area."""

from importlib import import_module

AREAS = ("scans", "filters", "joins", "aggregates", "windows", "tops_sets", "scalars", "market", "jobs", "streams", "candidates", "reports", "overview", "entries", "censuses", "screening", "qualification", "stores", "stages", "factor_space", "strategy", "interaction", "reconstruction", "projection")


def load():
    """Import every area once and return the registry module."""
    core = import_module("sessionloom.catalog.core")
    for area in AREAS:
        import_module(f"sessionloom.catalog.{area}")
    return core

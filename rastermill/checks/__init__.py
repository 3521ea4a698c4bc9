"""Queries over the fixture rasters, each with SQL that gives the same rows."""

from importlib import import_module

_MODULES = ("geometry", "seams", "tone", "stencils", "files", "requests", "synthesis")


def load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")

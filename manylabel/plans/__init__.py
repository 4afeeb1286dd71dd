"""Queries over the driver tables and their SQL counterparts."""

from importlib import import_module

MODULES = ["catalogue", "learning", "margins", "smoothing", "ingest"]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"manylabel.plans.{name}")

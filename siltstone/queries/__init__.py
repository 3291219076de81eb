"""Named queries over the driver's tables, one module for each part of the library."""

from importlib import import_module

MODULES = ["text", "relational", "retrieval", "mining", "structure", "upkeep", "reads", "knowledge", "assets"]


def load() -> None:
    """Imports every module, which registers its queries in the catalog."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")

"""Named queries over the driver's tables."""

from importlib import import_module

MODULES = ("vectors", "curation", "training", "experiments", "ingest")


def load_all() -> None:
    for name in MODULES:
        import_module(f"triskel.catalog.{name}")

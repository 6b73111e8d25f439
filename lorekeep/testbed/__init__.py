"""Inputs and registered queries over the driver's tables."""


def load() -> None:
    """Imports the modules that register queries."""
    from lorekeep.testbed import curation, retrieval, usage  # noqa: F401

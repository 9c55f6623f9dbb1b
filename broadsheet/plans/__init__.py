"""Queries over the driver's tables, and the inputs derived from them."""

import importlib

MODULES = ("geometry", "text", "layout", "articles", "segments", "reports", "documents", "registry")


def load_catalog():
    """All registered queries and oracles."""
    from broadsheet.plans import catalog

    for name in MODULES:
        importlib.import_module(f"broadsheet.plans.queries_{name}")
    return catalog.QUERIES, catalog.ORACLES

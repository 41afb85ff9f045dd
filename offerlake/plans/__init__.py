"""Job plans: the canonical views, the document job and the query catalogue."""

from importlib import import_module

QUERY_MODULES = ("queries_pricing", "queries_validation", "queries_links", "queries_export", "queries_extract", "queries_images", "queries_tables", "queries_store")


def load_queries() -> None:
    """Imports the modules that register queries."""
    for name in QUERY_MODULES:
        import_module(f"{__name__}.{name}")

"""Scans: document texts, lookups, layout tables, image files."""

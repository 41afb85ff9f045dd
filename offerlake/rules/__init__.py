"""Supplier rule sets: data and column expressions, no engine code."""

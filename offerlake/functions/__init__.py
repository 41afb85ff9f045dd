"""Column functions: text, numbers, keys. All native expressions, no Python workers."""

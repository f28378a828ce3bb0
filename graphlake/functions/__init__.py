"""Column functions: patterns and JSON paths, as native expressions."""

"""Column-level expressions and ordering helpers."""

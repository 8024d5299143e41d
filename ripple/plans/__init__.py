"""Composed plans: indexing, analysis and the query registry."""

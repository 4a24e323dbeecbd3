"""Queries over the given tables: each operator on views derived from them, with the same query in SQL."""
